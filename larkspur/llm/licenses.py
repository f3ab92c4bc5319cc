"""Licence scan by canonical digest lookup; DataFrame functions only.

A text is brought to a canonical form (case, copyright lines, equivalent
spellings, punctuation and white space) and its SHA-256 is hash-joined with
the digests of known texts.  Whole documents are looked up against whole
licences, and each line that speaks of a licence against known notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._spark import row_key, table

# Well-known licences (whole) and the notices that name one (a line).
KNOWN_WHOLE = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}
_CLAUSES = ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]


def _bsd(clauses: list[str]) -> list[str]:
    """The text with and without numbers before the clauses, for one holder and for several."""
    disclaimer = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
    start = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    lists = [" ".join(clauses), " ".join(f"{i}. {c}" for i, c in enumerate(clauses, 1))]
    return [f"{start} {x} {disclaimer.format(who)}" for x in lists for who in ("HOLDER", "HOLDERS", "OWNER")]


#: Further wordings of whole licences.
MORE_WHOLE = {"ISC": [KNOWN_WHOLE["ISC"].replace("and/or distribute", "and distribute")], "BSD-2-Clause": _bsd(_CLAUSES[:2]), "BSD-3-Clause": _bsd(_CLAUSES)}
#: Lines that may stand before a whole licence.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC License (ISCL)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License", "The BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License", "The BSD License"],
}
#: Digests of ``plain`` of long licences: whole, without the title, and without what follows the terms.
LONG_WHOLE = {
    "Apache-2.0": ["f92c423b6d6da66caa78abd6f49f73f5bc8715dca82e1a73f62d1e6eec41986c", "09ad3868555dada25cbf24199409a8c1e39fe8ef08d164adc6e98c1d02767793", "0c625737207ff21211498d94941901de5bca68c965547007c169a1e718b97f16", "b9716aee0165b59b48d4bde5d872f9dcf3730f616d607a38dd74b8fe3f9cc8f0", "222e2dbbc6f53ffea06883dcba68e5a19a4cc1b830ffe9cd6915444a740216e3", "f6da93decb4b3b62f583f61ad94c5b8024c106fcd8bffa3e27e1ba24e5c47b28"],
    "GPL-2.0": ["efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808", "4767c85efb312bbe244abef9b752be38b44e810f05ed9bfae182caf068d13fd3", "8fa94d3d812775805528fff117ea835ed908322b039e129b957550c1e107d3e2", "a268f9c0a6d81f308a4286dac3b04b899da32e1ba02acf6eb78972ce623846e1"],
    "GPL-3.0": ["a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191", "c50bb15c5f5e96b27d60ee792a7db1637c2e416eb98869999aab5af68506cd64", "4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19", "ce818a0d5cb7a9a9261f63641713dbb4ca4750284738a6c3f546d86d81a541d2"],
    "LGPL-2.1": ["4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df", "e94f6c31379c2076fae91e236d6000ea55d918637fc8f30749aa0fe22a265c7f", "98d365a8217633113a201b5777e4d26ae0eb1d88079c5e39838162abe1f18db4", "127c98b05c4e2851a27843fcf90984e5592c3841d8a6b7638dbcd00bcefe46dd"],
    "LGPL-3.0": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7"],
    "MPL-2.0": ["95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9", "e07dcdcc3b2c19db7e604dfb1498cc5dafa0e9cecf6ffc44f7c2b093fe9bafc2"],
    "CC0-1.0": ["cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e", "13a06619caac563ef75dbb6b16c7b185cd8a7255a4c7134aecf15ed03eeb0b9e"],
}
KNOWN_NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "all-rights-reserved": ["All rights reserved."],
}
#: Equivalent spellings, as patterns that both Java and RE2 read.
SPELLINGS = [("licence", "license"), ("sub ?license", "sublicense"), ("acknowledgement", "acknowledgment"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("favour", "favor"), ("organisation", "organization")]
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright[ \t]+(\(c\)|©|[0-9])|\(c\)[ \t]|©)[^\n]*$"
#: A line that names a holder, for Java; the notice of reserved rights in it is kept.  Lines of prose that begin with the word stay.
HOLDER_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:(?i:copyright)[ \t]+(?:\([cC]\)|©|[0-9]|[\[<{]|(?!(?i:notice|holder|owner|licen|law|statement|and|or|interest|disclaimer)s?\b)\p{Lu}[\p{Ll}0-9]|[Tt]he \p{Lu}\p{Ll}|by )|\([cC]\)[ \t]|©)[^\n]*?(?i:(all rights reserved)[^\n]*)?$"
#: Whole licences speak of one of these.
_WHOLE_HINT = "(?i)permi(?:ssion|tted)|licen[sc]e"
NOTICE_LINE = r"licen[sc]e|rights reserved"


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null."""
    x = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    x = F.regexp_replace(F.regexp_replace(x, "&", " and "), r"[^\p{L}\p{N}]+", " ")
    for found, put in SPELLINGS:
        x = F.regexp_replace(x, rf"\b{found}", put)
    return F.trim(x)


def plain(text: Column) -> Column:
    """The canonical form of a text without the lines that name a holder, by which licences are looked up."""
    return canonical(F.regexp_replace(F.regexp_replace(text, "\r", ""), HOLDER_LINE, " $1 "))


def known(spark: SparkSession) -> DataFrame:
    """license_id, whole, digest of the known texts: a few dozen rows."""
    rows = [(k, True, t) for k, t in KNOWN_WHOLE.items()] + [(k, False, t) for k, ts in KNOWN_NOTICES.items() for t in ts]
    rows += [(k, True, t) for k, ts in MORE_WHOLE.items() for t in ts]
    reserved = "All rights reserved. "
    rows += [(k, True, f"{title}. {kept}{t}") for k, whole, t in list(rows) if whole for title in ["", *TITLES[k]] for kept in ("", reserved) if title or kept]
    short = spark.createDataFrame(rows, "license_id string, whole boolean, text string").select("license_id", "whole", F.sha2(plain(F.col("text")), 256).alias("digest"))
    return short.unionByName(spark.createDataFrame([(k, True, d) for k, ds in LONG_WHOLE.items() for d in ds], short.schema)) if LONG_WHOLE else short


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """Looks every text of ``docs`` (doc_id, text, ...) up by its canonical digest.

    Returns per row doc_id, text_digest (null for a null text), license_id of
    the licence that the whole text is (with or without its title and the lines
    of its holders; else null) and notices, the sorted
    distinct ids of licences whose notice is a line of it.  Empty texts have
    the digest of the empty string.  Repeated rows come back as often.
    ``licenses`` is the fixed table of ``known`` unless given; it is broadcast.
    """
    licenses = F.broadcast(licenses if licenses is not None else known(docs.sparkSession))
    rows = docs.select("doc_id", "text", *row_key("doc_id", "text"), F.sha2(canonical(F.col("text")), 256).alias("text_digest"), F.when(F.col("text").rlike(_WHOLE_HINT), F.sha2(plain(F.col("text")), 256)).alias("plain_digest"))
    whole = licenses.where("whole").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    lines = rows.where(F.lower("text").rlike(NOTICE_LINE)).select("_k1", "_k2", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.where(F.lower("line").rlike(NOTICE_LINE)).select("_k1", "_k2", F.sha2(plain(F.col("line")), 256).alias("digest"))
    named = lines.join(F.broadcast(licenses.where("NOT whole").select("digest", "license_id")), "digest").groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set("license_id")).alias("notices"))
    out = rows.drop("text").join(F.broadcast(whole), rows["plain_digest"] == whole["digest"], "left").drop("digest", "plain_digest")
    return out.join(named, ["_k1", "_k2"], "left").select("doc_id", "text_digest", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document that is one, and the notices in its lines."""
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "text_digest", "license_id", F.array_join("notices", ",").alias("notices"))


def _sql(text: str) -> str:
    x = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', ' ', 'g')"
    x = f"regexp_replace(replace({x}, '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    for found, put in SPELLINGS:
        x = f"regexp_replace({x}, '\\b{found}', '{put}', 'g')"
    return f"sha256(trim({x}))"


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in rows)


OP2_SQL = f"""
WITH whole AS (SELECT {_sql("t")} AS digest, min(i) AS license_id FROM (VALUES {_values(list(KNOWN_WHOLE.items()))}) AS v(i, t) GROUP BY 1),
notice AS (SELECT {_sql("t")} AS digest, i AS license_id FROM (VALUES {_values([(k, t) for k, ts in KNOWN_NOTICES.items() for t in ts])}) AS v(i, t)),
line AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM documents),
named AS (
  SELECT doc_id, text, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT doc_id, text, {_sql("line")} AS digest FROM line WHERE regexp_matches(lower(line), '{NOTICE_LINE}')) JOIN notice USING (digest)
  GROUP BY doc_id, text)
SELECT d.doc_id, {_sql("d.text")} AS text_digest, w.license_id, coalesce(n.notices, '') AS notices
FROM documents d LEFT JOIN whole w ON w.digest = {_sql("d.text")}
LEFT JOIN named n ON n.doc_id IS NOT DISTINCT FROM d.doc_id AND n.text = d.text
"""
