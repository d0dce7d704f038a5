"""License scans by canonical digest lookup.

A text is brought to a canonical form: A-Z lower-cased, equivalent spellings united, copyright lines and
punctuation dropped, white space reduced. The digests of whole canonical texts are hash-joined to the
digests of known licences and notices. A document is looked up as a whole, by its blank-line
paragraphs, by its lines and by runs of consecutive paragraphs, each as an entire text of its own.

Null text counts as empty and matches nothing; very long texts are scanned whole. Rows with equal ids are scanned one by
one. A digest of two known texts has the first name of them. Other columns of the table, whatever their names, play
no part. An empty table gives no rows.
The known texts are a fixed list of some 300 KB, so their digests are broadcast.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import written
from runledger.llm.license_texts import NOTICES, texts

#: Spellings that licence matching treats as one (after lower-casing).
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("analogue", "analog"),
    ("fulfilment", "fulfillment"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("https://", "http://"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("non-commercial", "noncommercial"),
    ("&", " and "),
)
#: Endings that are one, as patterns and what stands for them.
ENDINGS: tuple[tuple[str, str], ...] = (
    (r"(author|organ|capital|categor|emphas|initial|maxim|optim|real|recogn|util)is(e|ing|ation)", r"\1iz\2"),
    (r"(fav|lab)our", r"\1or"),
    (r"(judg|acknowledg)ement", r"\1ment"),
    (r"(cent|calib)re", r"\1er"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The patterns mean the same to Java and RE2.
#: Lines that state a copyright: by the word, or by the sign; (c) alone may be a clause's letter and needs a year.
_COPYRIGHT = r"(^|\n)[ \t]*(copyright[ \t]*(\(c\)|©|[0-9])|\(c\)[ \t]*(copyright|[0-9][0-9][0-9][0-9])|©)[^\n]*"
_PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F“”‘’–—]+"
_EDGES = r" *\n *"


def canonical(text: Column) -> Column:
    """Canonical form with its lines kept apart."""
    x = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    for a, b in ENDINGS:
        x = F.regexp_replace(x, a, b.replace("\\", "$"))
    x = F.regexp_replace(x, _COPYRIGHT, "$1")
    x = F.regexp_replace(x, _PUNCTUATION, " ")
    return F.regexp_replace(F.trim(F.regexp_replace(x, " +", " ")), _EDGES, "\n")


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"\n+", " "))


#: Up to so many paragraphs, a known text is looked for with any of its paragraph breaks left out.
FREE_BREAKS = 10


def known(spark: SparkSession) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(license, digest, size) of the known texts, one row per digest; the shapes of those of several paragraphs.

    A shape is (length of the first paragraph, of the last, number of paragraphs). Lines of a short text may be
    paragraphs or not; the paragraphs of a long one are those that it has.
    """
    given = spark.createDataFrame(texts(), "license string, text string, headed boolean").select("license", "headed", canonical(F.col("text")).alias("lines"))
    rows, shapes = {}, set()
    for name, headed, lines in given.collect():
        parts = [p for p in lines.split("\n") if p]
        # A run of paragraphs below a heading is that of the text without one.
        if len(parts) > FREE_BREAKS:
            blocks = [" ".join(p.split("\n")) for p in re.split(r"\n\n+", lines.strip("\n"))]
            shapes |= set() if headed else {(len(blocks[0]), len(blocks[-1]), len(blocks))}
        elif not headed:
            heads, tails = ([len(" ".join(parts[:k])) for k in range(1, len(parts) + 1)], [len(" ".join(parts[k:])) for k in range(len(parts))])
            shapes |= {(heads[i], tails[j], n) for i in range(len(parts)) for j in range(i + 1, len(parts)) for n in range(2, j - i + 2)}
        form = " ".join(parts)
        key = (hashlib.md5(form.encode()).hexdigest(), len(form))
        rows[key] = min(name, rows.get(key, name))
    table = spark.createDataFrame([(name, *key) for key, name in rows.items()], "license string, digest string, size int")
    return table, sorted(x for x in shapes if x[2] > 1)


def _runs(paragraphs: Column, shapes: list[tuple[int, int, int]]) -> Column:
    """Runs of consecutive paragraphs that have the shape of a known text; few places have its first length."""
    firsts: dict[int, list[tuple[int, int]]] = {}
    for first, last, n in shapes:
        firsts.setdefault(first, []).append((last, n))
    lengths = F.array(*[F.lit(k) for k in firsts])
    listed = F.map_from_arrays(lengths, F.array(*[F.array(*[F.struct(F.lit(last).alias("last"), F.lit(n).alias("n")) for last, n in found]) for found in firsts.values()]))

    def of(p: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), lambda i: F.array_contains(lengths, F.length(F.get(p, i - 1))))

        def at(i: Column) -> Column:
            fitting = F.filter(listed[F.length(F.get(p, i - 1))], lambda f: F.length(F.get(p, i + f["n"] - 2)) == f["last"])
            return F.transform(fitting, lambda f: F.array_join(F.slice(p, i, f["n"]), " "))

        return F.flatten(F.transform(starts, at))

    # In a list of one, so that the paragraphs are made once for each text.
    return F.flatten(F.transform(F.array(F.filter(paragraphs, lambda x: x != "")), of))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of docs: <id_col>, text_digest, license (of the whole text, else null), notices, n_notices.

    notices: the licences of all matching units, in order, comma-separated; empty where there is none.
    """
    table, shapes = known(docs.sparkSession)
    table = written(table, "licenses")
    # A unit can match only if its length is that of a known text; the list is as long as the known texts are many.
    sizes = F.array(*[F.lit(r["size"]) for r in table.select("size").distinct().collect()])
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col).cast("long")
    source = docs.select(F.col(id_col).alias("id"), row.alias("row"), canonical(F.col(text_col)).alias("lines"))
    paragraphs = F.transform(F.split("lines", r"\n\n+"), whole)
    units = F.concat(F.array("whole"), paragraphs, F.split("lines", "\n"), _runs(paragraphs, shapes))
    candidates = F.transform(F.array_distinct(F.filter(units, lambda u: F.array_contains(sizes, F.length(u)))), F.md5)
    forms = source.withColumn("whole", whole(F.col("lines"))).select("id", "row", F.md5("whole").alias("text_digest"), candidates.alias("units"))
    forms = written(forms, "forms")
    ids = F.broadcast(table.select("digest", "license"))
    found = forms.where(F.size("units") > 0).select("row", F.explode("units").alias("digest")).join(ids, "digest")
    notices = found.groupBy("row").agg(F.sort_array(F.collect_set("license")).alias("all"))
    named = forms.select("id", "row", "text_digest").join(F.broadcast(table.select(F.col("digest").alias("text_digest"), "license")), "text_digest", "left")
    return named.join(notices, "row", "left").select(
        F.col("id").alias(id_col),
        "text_digest",
        "license",
        F.coalesce(F.array_join("all", ","), F.lit("")).alias("notices"),
        F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("n_notices"),
        *([] if row_col is None else [F.col("row").alias(row_col)]),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """The scan of documents for NOTICES in DuckDB SQL, without runs of paragraphs."""

    def form(text: str) -> str:
        x = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
        for a, b in SPELLINGS:
            x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
        for a, b in ENDINGS:
            x = f"regexp_replace({x}, {_quoted(a)}, {_quoted(b)}, 'g')"
        x = f"regexp_replace({x}, {_quoted(_COPYRIGHT)}, '\\1', 'g')"
        x = f"regexp_replace({x}, {_quoted(_PUNCTUATION)}, ' ', 'g')"
        return f"regexp_replace(trim(regexp_replace({x}, ' +', ' ', 'g'), ' '), {_quoted(_EDGES)}, chr(10), 'g')"

    def joined(lines: str) -> str:
        return f"trim(regexp_replace({lines}, '\\n+', ' ', 'g'), ' ')"

    values = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in NOTICES)
    return f"""
    WITH known AS (SELECT md5({joined(form('t'))}) AS digest, min(l) AS license FROM (VALUES {values}) v(l, t) GROUP BY 1),
    f AS (SELECT doc_id, {form('text')} AS lines FROM documents),
    w AS (SELECT doc_id, lines, md5({joined('lines')}) AS text_digest FROM f),
    u AS (SELECT doc_id, text_digest AS digest FROM w
          UNION ALL SELECT doc_id, md5({joined('p')}) FROM (SELECT doc_id, unnest(regexp_split_to_array(lines, '\\n\\n+')) AS p FROM w)
          UNION ALL SELECT doc_id, md5(l) FROM (SELECT doc_id, unnest(string_split(lines, chr(10))) AS l FROM w)),
    n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(DISTINCT license) AS n_notices FROM u JOIN known USING (digest) GROUP BY doc_id)
    SELECT w.doc_id, w.text_digest, k.license, coalesce(n.notices, '') AS notices, coalesce(n.n_notices, 0)::BIGINT AS n_notices
    FROM w LEFT JOIN known k ON k.digest = w.text_digest LEFT JOIN n ON n.doc_id = w.doc_id
    """
