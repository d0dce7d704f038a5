import pathlib

from pyspark.sql import functions as F

from runledger.llm import license_texts
from runledger.llm.license_texts import NOTICES
from runledger.llm.licenses import scan

MIT = next(t for i, t in NOTICES if i == "MIT" and t.startswith("Permission"))
APACHE = next(t for i, t in NOTICES if i == "Apache-2.0" and "obtain" in t)


def scanned(spark, texts):
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)]
    return {r["doc_id"]: (r["license"], r["notices"], r["n_notices"]) for r in scan(spark.createDataFrame(rows, "doc_id long, text string, license string, row int")).collect()}


def test_variants_of_whole_texts(spark):
    changed = MIT.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ,, ").replace('"', "“")
    texts = [MIT, "Copyright (c) 2020 Somebody & Co\n© 2021 Else\n\n" + changed, MIT.replace("merge", "fuse"), APACHE.replace("http:", "https:").replace("\n", "  \n\n"), None, "", "All  rights\nreserved"]
    got = scanned(spark, texts)
    assert [got[k][0] for k in range(7)] == ["MIT", "MIT", None, "Apache-2.0", None, None, "LicenseRef-all-rights-reserved"]
    assert got[4] == got[5] == (None, "", 0)


def test_lines_and_paragraphs(spark):
    text = f"Intro words.\n\n{MIT}\n\nmore\nALL RIGHTS RESERVED!\nLicensed under CC BY-NC 4.0\nLicensed under CC BY-NC 4.0.\n" + "tail " * 300_000
    got = scanned(spark, [text, "x"])
    assert got[0] == (None, "CC-BY-NC-4.0,LicenseRef-all-rights-reserved,MIT", 3)


def test_repeated_rows_null_ids_and_no_rows(spark):
    frame = spark.createDataFrame([(None, "All rights reserved."), (3, "a"), (3, "a")], "doc_id long, text string")
    assert len(scan(frame).collect()) == 3
    assert scan(frame.where(F.lit(False))).collect() == []


def test_standard_files(spark):
    here = pathlib.Path(license_texts.__file__).with_name("license_files")
    files = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(here.glob("*.txt"))}
    paragraphs = MIT.replace("\n", "\n\n")
    mit = f"MIT License\n\nCopyright (c) 2024 Some One\n\n{paragraphs}\n"
    bsd = next(t for i, t in NOTICES if i == "BSD-2-Clause").split("\n")
    two = "BSD 2-Clause License\n\nCopyright (c) 2024, Some One\nAll rights reserved.\n\n" + "\n\n".join(bsd) + "\n"
    three = "BSD 3-Clause License\n\nCopyright (c) 2024, Some One\n\n" + "\n\n".join([*bsd[:3], "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.", bsd[3]])
    gpl = files["GPL-3.0-only"]
    header = gpl[gpl.index("    This program is free software: you") : gpl.index("Also add information")]
    source = "import x\n\n# prog\n# Copyright (C) 2020  A\n#\n" + "".join(f"# {x.strip()}\n" for x in header.strip().split("\n")) + "\n\nrest\n"
    given = [*files.values(), mit, two, three, source, f"Words.\n\n{paragraphs}\n\nmore", "a\n\n" + gpl + "\n\nb", mit.replace("merge", "fuse")]
    got = scanned(spark, given)
    n = len(files)
    assert [got[k][0] for k in range(n)] == list(files)
    assert [got[n + k][0] for k in range(7)] == ["MIT", "BSD-2-Clause", "BSD-3-Clause", None, None, None, None]
    assert [got[n + k][1] for k in range(7)] == ["MIT", "BSD-2-Clause,LicenseRef-all-rights-reserved", "BSD-3-Clause", "GPL-3.0-or-later", "MIT", got[list(files).index("GPL-3.0-only")][1], ""]


def test_clause_letters_are_no_copyright_lines(spark):
    here = pathlib.Path(license_texts.__file__).with_name("license_files")
    apache = (here / "Apache-2.0.txt").read_text("utf-8")
    assert "(c) You must retain" in apache
    altered = apache.replace("(c) You must retain", "(c) You may ignore")
    # One line for each paragraph.
    wrapped = "\n\n".join(" ".join(p.split()) for p in apache.split("\n\n"))
    noticed = f"(c) 2021 Some One\n(c) Copyright Some One\n\n{MIT}"
    got = scanned(spark, [apache, altered, wrapped, noticed, MIT.replace("permission", "authorisation")])
    assert [got[k][0] for k in range(5)] == ["Apache-2.0", None, "Apache-2.0", "MIT", None]


def test_equivalent_endings(spark):
    from runledger.llm.licenses import canonical

    row = spark.createDataFrame([("Authorised organisations may recognise favours, labour and judgements; a revised promise whilst the centres.",)], "t string").select(canonical(F.col("t"))).first()[0]
    assert row == "authorized organizations may recognize favors labor and judgments a revised promise while the centers"


def test_codes_without_what_stands_around_them(spark):
    here = pathlib.Path(license_texts.__file__).with_name("license_files")
    by, alike, affero, general = ((here / f"{x}.txt").read_text("utf-8") for x in ("CC-BY-4.0", "CC-BY-SA-4.0", "AGPL-3.0-only", "GPL-3.0-only"))
    code = by[by.index("Creative Commons Attribution 4.0 International Public") : by.rindex("=====================================================")].rstrip("=\n")
    one_line_each = "\n\n".join(" ".join(p.split()) for p in affero.split("\n\n"))
    terms = affero[: affero.index("END OF TERMS AND CONDITIONS") + 27]
    network = affero[affero.index("  13. Remote") : affero.index("  14. Revised")]
    got = scanned(spark, [code, code.replace("NonCommercial", "x").replace("irrevocable", "revocable"), f"words\n\n{code}\n\nmore", alike.upper(), one_line_each, terms, general.replace(general[general.index("  13. Use") : general.index("  14. Revised")], network)])
    assert [got[k][0] for k in range(7)] == ["CC-BY-4.0", None, None, "CC-BY-SA-4.0", "AGPL-3.0-only", "AGPL-3.0-only", None]
    assert got[2][1] == "CC-BY-4.0"
