"""License texts in other spellings, and notices."""

import hashlib

import __spark_entry__ as entry
from compare import differences, duck
from edge_rows import ROWS, documents, empty
from rankweave.llm import licenses
from rankweave.llm.license_texts import LICENSE_TEXTS, notice_rows


def test_matches_sql(spark, folder):
    name = "op6_license_scan"
    assert differences(entry.queries()[name](spark, folder), duck(folder), entry.oracle_sql()[name]) is None


def scan(spark, *texts):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}


def test_whole_texts(spark):
    names = sorted(LICENSE_TEXTS)
    plain = scan(spark, *[LICENSE_TEXTS[n] for n in names])
    assert [plain[i].license for i in range(len(names))] == names
    got = scan(
        spark, "Copyright (c) 2020 Jo\n\n" + LICENSE_TEXTS["MIT"].replace("\n", " ").upper(),
        LICENSE_TEXTS["BSD-3-Clause"].replace("COPYRIGHT HOLDER", "COPYRIGHT OWNER"),
        LICENSE_TEXTS["MIT"].replace("sublicense", "sub-licence"), LICENSE_TEXTS["MIT"] + " and more",
    )
    assert [got[i].license for i in range(4)] == ["MIT", "BSD-3-Clause", "MIT", None]


def test_notices(spark):
    got = scan(spark, "a\nReleased under the MIT Licence.\nb", "licensed under cc by-nc 4.0", "we talk of licenses", "SPDX-License-Identifier: ISC")
    assert [got[i].notices for i in range(4)] == ["MIT", "CC-BY-NC-4.0", "", "ISC"]
    assert got[1].digest == hashlib.sha256(b"licensed under cc by nc 4 0").hexdigest()


def test_every_notice_is_found(spark):
    rows = notice_rows()
    got = scan(spark, *[text for _, text in rows], "x\n* This software is RELEASED under the GPLv3.\ny")
    assert [got[i].notices for i in range(len(rows))] == [name for name, _ in rows]
    assert got[len(rows)].notices == "GPL-3.0"


def test_full_texts(spark):
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"]
    got = scan(spark, *[" ".join(LICENSE_TEXTS[n].split()[:-1]) + "\n\n" + LICENSE_TEXTS[n].split()[-1] for n in names[5:]],
               *[LICENSE_TEXTS[n].replace("\n", "\r\n") for n in names], LICENSE_TEXTS["Apache-2.0 (terms)"])
    assert [got[i].license for i in range(len(got))] == [*names[5:], *names, "Apache-2.0 (terms)"]


def test_edges(spark):
    rows = licenses.scan(documents(spark, clashes=True)).collect()
    assert len(rows) == len(ROWS) and all(r.license is None and r.notices == "" for r in rows)
    assert licenses.scan(empty(spark)).count() == 0
