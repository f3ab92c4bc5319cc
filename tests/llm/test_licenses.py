"""Whole licences as they stand in files: with titles, holders and notices of rights."""

import os

import pytest

from larkspur.llm import licenses as L

COMMON = "/usr/share/common-licenses"
FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def ids(spark, texts):
    got = L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(r.license_id, r.notices) for r in sorted(got, key=lambda r: r.doc_id)]


def test_titles_and_holders(spark):
    mit, isc, bsd = L.KNOWN_WHOLE["MIT"], L.KNOWN_WHOLE["ISC"], L.MORE_WHOLE["BSD-3-Clause"][0]
    texts = [
        mit,
        f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{mit}\n",
        f"The MIT License (MIT)\r\n\r\nCopyright The Larkspur Authors\r\nCopyright 2021, 2022 B. Person\r\n\r\n{mit}",
        f"ISC License\n\nCopyright (c) 2020, C. Person\n\n{isc}",
        f"BSD Zero Clause License\n\nCopyright (C) 2020 by D. Person\n\n{L.KNOWN_WHOLE['0BSD']}",
        f"BSD 3-Clause License\n\nCopyright (c) 2020, E. Person\nAll rights reserved.\n\n{bsd}",
        f"BSD 3-Clause License\n\nCopyright (c) 2020, E. Person. All rights reserved.\n\n{bsd}",
        f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{mit} And one more sentence.",
        "Copyright (c) 2020 X. All rights reserved.",
        "copyright notice and this permission notice",
    ]
    got = ids(spark, texts)
    assert [i for i, _ in got] == ["MIT", "MIT", "MIT", "ISC", "0BSD", "BSD-3-Clause", "BSD-3-Clause", None, None, None]
    assert got[8][1] == ["all-rights-reserved"] and got[6][1] == ["all-rights-reserved"] and got[9][1] == []


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no licence files here")
def test_licence_files(spark):
    texts = [open(f"{COMMON}/{f}").read() for f in FILES]
    assert [i for i, _ in ids(spark, texts)] == list(FILES.values())
    bare = texts[0].split("END OF TERMS AND CONDITIONS")[0]
    filled = texts[0].replace("[yyyy] [name of copyright owner]", "2020 F. Person")
    assert [i for i, _ in ids(spark, [bare, filled])] == ["Apache-2.0"] * 2


def test_a_licence_file_with_wrapped_lines(spark):
    body = L.KNOWN_WHOLE["MIT"].split()
    wrapped = "\n".join(" ".join(body[i : i + 9]) for i in range(0, len(body), 9))
    assert ids(spark, [f"MIT License\n\nCopyright (c) 2023 G. Person\n\n{wrapped}\n"])[0][0] == "MIT"
