"""Licence scan by canonical digest, in DataFrame functions only.

A text is brought to a canonical form (case, spellings, copyright notices,
titles, punctuation and white space), its SHA-256 is taken, and the digests are joined
with those of known licence texts, which pass through the same form.  Whole
texts are compared: a document that merely holds a licence has another digest.

Defined results: a null text has a null digest and no licence; a text that is
empty in canonical form has the digest of the empty string and no licence;
equal licence texts under several names give the least name; repeated rows
give a row each; extra columns are never read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.shared import small_enough

# Letters folded, the copyright line of the SQL, and equivalent spellings.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;.-]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
# Copyright notices have a sign, a year or a capitalised holder, begin a line and end with
# it or where a licence begins, 200 characters on at most; wrapped lines such as "copyright notice and
# this permission notice" have none of these.  Titles stand before everything else.
_MARGIN = r"(^|\n)[ \t#*/;.-]*"
_REST = r"[^\n]{0,200}?(?=\n|\z|permission (?:is hereby granted|to use)|redistribution and use|licensed under)"
HELD = _MARGIN + r"[Cc]opyright[ \t]+(?:by[ \t]+)?(?!Notice|Holder|Owner|Law|License|Act)[A-Z][a-z]" + _REST.replace("permission", "[Pp]ermission").replace("redistribution", "[Rr]edistribution").replace("licensed", "[Ll]icensed")
NOTICE = _MARGIN + r"(?:copyright[ \t:,]*(?:\(c\)|©|[<\[{]?(?:[12][0-9]{3}|year|yyyy)\b)|(?:\(c\)|©)[ \t]*(?:copyright[ \t]*)?[<\[{]?(?:[12][0-9]{3}|year|yyyy)\b)" + _REST
RESERVED = _MARGIN + r"all rights reserved\b\.?"
TITLE = r"^[\s#*/;=-]*(?:the )?(mit|isc|bsd [23]-clause) (?:license|licence)(?:[ \t]*\((?:mit|isc|bsd-[23]-clause)(?: license)?\))?(?=[\s:=.*-]|\z)"
SPELLINGS = (
    (r"https?://", "http "),
    (r"\blicence", "license"),
    (r"\bcopyright holder\b", "copyright owner"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\bfavour", "favor"),
    (r"\bnon-?commercial\b", "noncommercial"),
    (r"\bsub-?license", "sublicense"),
    (r"\bper cent\b", "percent"),
    (r"&", " and "),
)
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Short licence texts and notices in common use, by SPDX name.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = {
    "MIT": MIT,
    "MIT (titled)": "MIT License\n\n" + MIT,
    "ISC": ISC,
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT (line)": "Licensed under the MIT License.",
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0 (line)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (line)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0 (line)": "Licensed under CC0 1.0.",
    "GPL-3.0 (line)": "Licensed under the GNU General Public License v3.0.",
}


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"


def full_texts() -> dict[str, str]:
    """Whole licence texts beside those of KNOWN: BSD, and the files of license_texts by their names."""
    out = {"ISC (titled)": "ISC License\n\n" + ISC}
    for name, text in (("BSD-2-Clause", BSD % ""), ("BSD-3-Clause", BSD % BSD_3)):
        out |= {name: text, f"{name} (titled)": f"{name[:5].replace('-', ' ')}-Clause License\n\n{text}"}
    return out | {p.stem: p.read_text() for p in (Path(__file__).parent / "license_texts").glob("*.txt")}


def canonical(text: Column) -> Column:
    """Words of the text in canonical form, one space between them."""
    out = F.translate(F.regexp_replace(text, HELD, "$1"), UPPER, LOWER)
    out = F.regexp_replace(F.regexp_replace(out, NOTICE, "$1"), RESERVED, "$1")
    out = F.regexp_replace(F.regexp_replace(out, TITLE, "$1 license"), r"\s+", " ")  # spellings of two words may be wrapped
    for found, instead in SPELLINGS:
        out = F.regexp_replace(out, found, instead)
    return F.trim(F.regexp_replace(out, NOT_WORD, " "))


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license, text) of the given or the built-in licence texts."""
    rows = sorted((KNOWN | full_texts() if texts is None else texts).items())
    return spark.createDataFrame(rows, "license string, text string")


def scan_licenses(documents: DataFrame, licenses: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """One row per document: id, digest of the canonical text, license or null.

    One pass without a shuffle while there are at most ``broadcast_rows``
    licences; beyond, a shuffle join on the digest.
    """
    form = canonical(F.col("text"))
    known = licenses.select("license", form.alias("form")).where("license is not null and form <> ''")
    known = known.groupBy(F.sha2("form", 256).alias("k_digest")).agg(F.min("license").alias("license"))
    if small_enough(licenses, broadcast_rows):
        known = F.broadcast(known)
    docs = documents.select(F.col(id_col), F.sha2(canonical(F.col(text_col)), 256).alias("digest"))
    return docs.join(known, F.col("digest") == F.col("k_digest"), "left").drop("k_digest")
