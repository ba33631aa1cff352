"""Secret scan, pseudonyms and licence rules."""

import hashlib
import re
import textwrap
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scorebook.llm import license_scan, pii_pseudonyms, secret_scan

SOURCE = '''
# password: in a comment = "notThisOne1"
db_user = "bob"
SALT_PART = "s3cr3tPart1"
db_password = SALT_PART + "xyz-9981"
api_key: 'abcd1234efgh'
{"clientSecret": "Zx81kkqq!", "token_length": "12345678aB"}
<password>Hunter22222</password>
url = "http://a.b/c"
export GH_TOKEN=ghp_abcdEFGH1234
password = changeme123456
if secret == "Abcdefg123": pass
const privateKey = `k9-QQ-aa-77-zz`;
'''


def test_lexer_traces_literals_to_sensitive_names():
    got = {SOURCE[a:b] for a, b in secret_scan.lexed(SOURCE)}
    assert got == {"s3cr3tPart1", "xyz-9981", "abcd1234efgh", "Zx81kkqq!", "Hunter22222", "ghp_abcdEFGH1234", "k9-QQ-aa-77-zz"}


@pytest.mark.parametrize("line", [
    "Server=db1;User Id=sa;Pwd=Xk29fqLw77;", 'const u = "bob"; const dbPwd = "Xk29fqLw77";', 'var a=1;var b={u:"x",dbPwd:"Xk29fqLw77"};f();', "url: http://a.b/c#top pwd=Xk29fqLw77",
    "link = https://a.b//c; passphrase = 'Xk29fqLw77' # note", 'db_pwd: str = "Xk29fqLw77"', 'const apiSecret: string = "Xk29fqLw77";', 'let credential: string | null="Xk29fqLw77"',
    "privateKey: Optional[str] = 'Xk29fqLw77'", "const PWD: &'static str = \"Xk29fqLw77\";", 'pwds: Map<string, string> = x; pwd: Xk29fqLw77', "pwd: Xk29fqLw77", "x { pwd = Xk29fqLw77 } // end"])
def test_every_statement_of_a_line_is_read(line):
    assert [line[a:b] for a, b in secret_scan.lexed(line)] == ["Xk29fqLw77"]
    assert "Xk29fqLw77" not in secret_scan.mask(line)


@pytest.mark.parametrize("line", ["  ; pwd = Xk29fqLw77", "# pwd = Xk29fqLw77", "a = 1 // pwd = Xk29fqLw77", "a = 1 -- pwd = Xk29fqLw77", "pwd: SecretString = load()"])
def test_comments_and_types_are_no_secrets(line):
    assert secret_scan.lexed(line) == []


@pytest.mark.parametrize("name,least,most", [("dbPassword", 1, 1), ("API-KEY", 1, 1), ("user", 0, 0), ("password_hint", 0, 0.4), ("passphrase", 1, 1), ("keyboard", 0, 0)])
def test_name_scores(name, least, most):
    assert least <= secret_scan.name_score(name) <= most


def brute_base(text):
    """The base kinds by their definition, with no shortcuts."""
    kinds = [("assign", r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
              r"[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", 12), ("access", r"(AKIA[A-Z0-9]+)", 18), ("hex", r"([0-9a-f]+)", 16)]
    spans = [(m.start(), n, m.end()) for n, (_, p, least) in enumerate(kinds) for m in re.finditer(p, text) if len(m[1]) >= least]
    return [sum(s[1] == n for s in spans) for n in range(3)], ",".join(f"{kinds[n][0]}:{a}:{b}" for a, n, b in sorted(spans))


TEXTS = [None, "", SOURCE, "héé token=AAAAbbbbCCCC11 x", "Tokenſ=abc password = short", "AKIA" + "B7" * 7, "AKIA" + "B7" * 6 + "b", "0123456789abcdef0 " * 3,
         "ToKeN: 'aaaaaaaaaaaa' secretpassword=aaaaaaaaaaaatoken=bbbbbbbbbbbb", "Kapi_Key=aaaaaaaaaaaaa", "a" * 50_000 + " apikey=" + "f" * 40, "日本 secret:日本 secret:abcdefghijkl"]


def test_secret_scan(frame):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, ""), (None, TEXTS[3]), (2, SOURCE)]
    got = secret_scan.scan_secrets(frame(rows)).collect()
    expected = Counter()
    for i, t in rows:
        counts, joined = brute_base(t or "")
        expected[(i, *counts, hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == expected
    for r in got:
        base = brute_base(dict(rows)[r.doc_id] or "")[1]
        assert [s for s in r.spans.split(",") if not s.startswith("literal")] == base.split(",")
    assert secret_scan.scan_secrets(frame([])).count() == 0


def test_masking(frame):
    docs = frame([(1, SOURCE), (2, None), (3, "x"), (3, "x"), (4, "token=abcdefghijklmnop and AKIA" + "B7" * 8)])
    got = secret_scan.mask_secrets(docs)
    assert got.columns == docs.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert "s3cr3tPart1" not in rows[1].text and 'db_user = "bob"' in rows[1].text and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None and rows[4].text == "token=[SECRET] and [SECRET]" and got.count() == 5


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(frame, spark):
    text = ("mail efcd.60@mail4.example.com, call +1 (386) 555-3733 or 386-555-3733; card 4111 1111 1111 1111, not 4111111111111112; ip 64.149.193.29, "
            "not 300.1.1.1; ssn 123-45-6789, not 000-12-3456; on 1999-02-28, 31.12.2001, not 30/02/2000; iban DE89 3704 0044 0532 0130 00")
    docs = frame([(1, text), (2, "again: 4111-1111-1111-1111 and 1999-02-28"), (3, None), (4, ""), (4, ""), (5, "4" * 30 + " x" * 30_000)])
    out = pii_pseudonyms.pseudonymize(docs, "k1").cache()
    assert out.count() == 6 and out.columns == [c for c in docs.columns if c != "n_pii"] + ["n_pii"]
    rows = {r.doc_id: r for r in out.collect()}
    new = rows[1].text
    assert rows[1].n_pii == 9 and rows[3].text is None and rows[4].text == "" and rows[5].n_pii == 0
    for keep in ("4111111111111112", "300.1.1.1", "000-12-3456", "30/02/2000"):
        assert keep in new
    for gone in ("efcd", "555-3733", "1111 1111", "64.149.193.29", "123-45-6789", "1999-02-28", "31.12.2001", "3704"):
        assert gone not in new
    shape = re.fullmatch(r"mail [a-z]{4}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com, call \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4}); card ([\d ]{19}), not .*; ip ([\d.]+), .*; "
                         r"ssn (\d{3}-\d\d-\d{4}), .* on (\d{4}-\d\d-\d\d), (\d\d\.\d\d\.\d{4}), .* iban (DE\d\d [\d ]{22})", new)
    assert shape and shape[1] + shape[2] + shape[3] == shape[4] + shape[5] + shape[6]
    card = shape[7].replace(" ", "")
    assert luhn(card) and card in rows[2].text.replace("-", "") and shape[10] in rows[2].text
    iban = shape[12].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert pii_pseudonyms.pseudonymize(docs, "k2").where("doc_id = 1").first().text != new
    assert pii_pseudonyms.pseudonymize(frame([]), "k").count() == 0


@pytest.mark.parametrize("kind", ["date", "ip", "phone", "card"])
def test_pseudonyms_are_permutations(spark, kind):
    n = 3000
    made = {"date": F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd"),
            "ip": F.concat_ws(".", F.lit("10"), F.lit("0"), (F.col("id") / 256).cast("int"), F.col("id") % 256),
            "phone": F.concat(F.lit("212-555-"), F.lpad(F.col("id").cast("string"), 4, "0")),
            "card": F.expr("""filter(transform(sequence(0, 9), c -> concat('400000000', lpad(cast(id as string), 6, '0'), cast(c as string))), x -> luhn_check(x))[0]""")}[kind]
    out = pii_pseudonyms.pseudonymize(spark.range(n).select(made.alias("text")), "k")
    assert out.where("n_pii = 1").select("text").distinct().count() == n
    assert pii_pseudonyms.pseudonymize(out, "other").where("n_pii = 1").count() == n  # valid again


BESIDE = [
    ("4111111111111111 12/27", ["4111111111111111"], 1), ("4111 1111 1111 1111 123", ["4111 1111 1111 1111"], 1), ("4111111111111111 12", ["4111111111111111"], 1),
    ("row 5 4111 1111 1111 1111 end", ["4111 1111 1111 1111"], 1), ("99 88 77 66 55 4111-1111-1111-1111", ["4111-1111-1111-1111"], 1),
    ("4111 1111 1111 1111 5500 0000 0000 0004", ["4111 1111 1111 1111", "5500 0000 0000 0004"], 2), ("3782 822463 10005 1234", ["3782 822463 10005"], 1),
    ("4111111111111111 1999-02-28", ["4111111111111111", "1999-02-28"], 2), ("2023 386-555-3733", ["386-555-3733"], 1), ("41 11 11 11 11 11 11 11", ["41 11 11 11"], 1),
    ("ES91 2100 0418 4502 0005 1332 4111 1111 1111 1111", ["2100 0418", "4111 1111 1111 1111"], 2), ("ES91 2100 0418 4502 0005 1332 CODE", ["2100 0418"], 1),
    ("at 2001-04-05T10:00:00Z", ["2001-04-05"], 1), ("4111111111111111 2001-04-05T10:00:00Z", ["4111111111111111", "2001-04-05"], 2),
    ("on 12/25/1999", ["12/25/1999"], 1), ("4111111111111111 12/25/1999", ["4111111111111111", "12/25/1999"], 2), ("not 13/32/1999", [], 0),
    ("4111 1111 1111 1111 192.168.7.9", ["4111 1111 1111 1111", "192.168.7.9"], 2), ("4111111111111111 77@mail.org", ["4111111111111111", "77@mail"], 2),
    ("1 2 3 4 5 " * 1000 + "4111 1111 1111 1111", ["4111 1111 1111 1111"], None)]


def test_values_beside_other_digits(spark):
    docs = spark.createDataFrame([(i, text) for i, (text, _, _) in enumerate(BESIDE)], "doc_id long, text string").coalesce(1)
    for row in pii_pseudonyms.pseudonymize(docs, "k").collect():
        text, gone, n = BESIDE[row.doc_id]
        assert not [g for g in gone if g in row.text] and n in (None, row.n_pii), (text[-60:], row.text[-60:], row.n_pii)
        assert re.sub("[0-9a-z]", "0", row.text.lower()) == re.sub("[0-9a-z]", "0", text.lower()) or "192." in text
        assert ("CODE" in row.text) == ("CODE" in text) and (" 123" in row.text or not text.endswith(" 123"))


def test_month_first_dates_are_permuted(spark):
    days = spark.range(73_049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d")).where("day(d) > 12 AND year(d) % 10 = 1")
    out = pii_pseudonyms.pseudonymize(days.select(F.date_format("d", "MM/dd/yyyy").alias("text")), "k")
    assert out.where("n_pii = 1").select("text").distinct().count() == days.count()
    assert out.where("substr(text, 4, 2) <= '12'").count() == 0


def test_feistel_is_a_permutation(spark):
    mixed = pii_pseudonyms.feistel(F.floor(F.col("id") / 4297), F.col("id") % 4297, 17, 4297, "k", "date")
    got = spark.range(17 * 4297).select(mixed.alias("s")).select(F.col("s.a") * 4297 + F.col("s.b")).distinct()
    assert got.count() == 17 * 4297


def test_pseudonyms_run_no_python(frame):
    plan = pii_pseudonyms.pseudonymize(frame([(1, "x")]), "k").select("text")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


MIT = '''The MIT License (MIT)

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
'''


@pytest.mark.parametrize("text,expected", [
    ("Prose here.\nReleased under the MIT License.\nMore.", [("MIT", "reference")]),
    (MIT, [("MIT", "reference"), ("MIT", "text")]),
    ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.", [("Apache-2.0", "notice")]),
    ("Licensed under the Apache License, Version 2.0.", [("Apache-2.0", "reference")]),
    ("// SPDX-License-Identifier: BSD-3-Clause\nint x;", [("bsd-3-clause", "tag")]),
    ("Copyright 2019 A Corp. All rights reserved.", [("proprietary", "reference")]),
    ("The license of the driver.\nPermission to leave.", []),
    ("Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.", [("CC-BY-NC-4.0", "reference"), ("GPL-3.0-only", "reference")]),
])
def test_license_rules(text, expected):
    found = license_scan.scan(text)
    assert [(f[0], f[1]) for f in found] == expected
    assert all(text[a:b].strip() == text[a:b] and text[a:b] for _, _, a, b in found)


def brute_licenses(text):
    """Every line of a text on its own: enough where licences are single lines."""
    names = {"released under the mit license": "MIT", "licensed under the apache license, version 2.0": "Apache-2.0", "licensed under cc by-nc 4.0": "CC-BY-NC-4.0",
             "this work is licensed under the gnu general public license, version 3": "GPL-3.0-only", "all rights reserved": "proprietary"}
    return ",".join(sorted({names[x] for x in (line.strip().rstrip(".").lower() for line in text.split("\n")) if x in names}))


def test_license_scan(spark, frame):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(docs).collect()}
    assert got == {r.doc_id: brute_licenses(r.text) for r in docs.collect()} and any(got.values())
    odd = frame([(1, None), (1, ""), (None, "MIT License"), (2, "licence. " * 20_000)])
    assert Counter(r.licenses for r in license_scan.scan_licenses(odd).collect()) == Counter({"": 3, "MIT": 1})
    assert license_scan.scan_licenses(frame([])).count() == 0


BSD = """Copyright (c) 2011, The Holders.
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
APACHE = """Copyright 2019 The Authors. All Rights Reserved.

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
"""


def gnu(what, sentence):
    return (f"This {what} is free software{sentence}\n\nThis {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
            "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n")


WHOLE = {
    "MIT": MIT.replace("The MIT License (MIT)\n", ""), "BSD-3-Clause": BSD, "BSD-2-Clause": BSD[: BSD.index("3. ")], "Apache-2.0": APACHE,
    "GPL-3.0-or-later": gnu("program", ": you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
                            "Foundation, either version 3 of the License, or (at your option) any later version."),
    "GPL-2.0-only": gnu("program", "; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    "LGPL-2.1-or-later": gnu("library", "; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
                             "Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
           "notice and this permission notice appear in all copies.\n",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
               "one at http://mozilla.org/MPL/2.0/.\n",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
@pytest.mark.parametrize("width", [10_000, 80, 70, 40])
@pytest.mark.parametrize("first,each,last", [("", "", ""), ("", "# ", ""), ("/*\n", " * ", "\n */"), ("", "// ", ""), ("<!--\n", "  ", "\n-->"), ("", ";; ", ""), ("", "    ", "")])
def test_whole_licences_wrapped_and_in_comments(name, width, first, each, last):
    paragraphs = [textwrap.wrap(p, width) if "\nAll" not in p else p.split("\n") for p in WHOLE[name].strip().split("\n\n")]
    body = "\n".join((each + line).rstrip() for k, p in enumerate(paragraphs) for line in ([""] if k else []) + p)
    for ends in ("\n", "\r\n"):
        text = (first + body + last + "\nint main() { return 0; }\n").replace("\n", ends)
        found = license_scan.scan(text)
        assert [f[0] for f in found] == [name], found
        assert text[found[0][2]: found[0][3]].strip() and found[0][3] - found[0][2] > 60


def test_no_known_sentence_lacks_a_hint():
    assert all(license_scan.HINT.search(s) for s in license_scan.SENTENCES)
    assert {i for i in license_scan.SENTENCES.values()} <= {i for _, _, rule in license_scan.RULES for i in rule} | {"gpl.warranty"}


def test_reserved_rights_alone_are_proprietary():
    assert [f[0] for f in license_scan.scan("Copyright 2019 A Corp.\nAll rights reserved.\n\n" + "Prose here. " * 5 + "\nMIT License\n")] == ["proprietary", "MIT"]


def test_licences_in_odd_texts():
    assert [f[0] for f in license_scan.scan("This work is licensed under the GNU General Public License, version\n3. More text.")] == ["GPL-3.0-only"]
    assert [f[0] for f in license_scan.scan("// This Source Code Form is subject to the terms of the Mozilla Public License,\n// v. 2.0. If a copy")] == ["MPL-2.0"]
    assert license_scan.scan("license " + " " * 100_000 + "x\n" + "*" * 100_000 + "x\n" + "." * 100_000 + "\n" + "a. " * 50_000 + ". " * 50_000) == []


def test_long_domains(spark, frame):
    from scorebook.llm import pii_pseudonyms
    texts = ["x@" + "a." * 1_000_000, "x@" + "a." * 3000 + "com", "me@mail.example.org.", "x@a.b.c.de", "y@" + "a-b." * 100 + "org"]
    got = {r.doc_id: r for r in pii_pseudonyms.pseudonymize(frame(list(enumerate(texts))), "k").collect()}
    assert [got[i].n_pii for i in range(5)] == [0, 0, 1, 1, 1]
    assert got[0].text == texts[0] and got[1].text == texts[1]
    from pyspark.sql import functions as F
    clash = frame([(1, "a@b.org")]).withColumn("_found", F.lit(7)).withColumn("_named", F.lit(8))
    row = pii_pseudonyms.pseudonymize(clash, "k").first()
    assert (row["_found"], row["_named"], row.n_pii) == (7, 8, 1)


@pytest.mark.parametrize("text,secrets", [
    ("password = get_password(config)", []), ('password = os.environ["API_KEY"]', []), ("secret = settings.SECRET_KEY", []),
    ("token = request.headers.get('X-Api-Key-1')", []), ('secret = os.getenv("X", "Xk29fqLw77")', ["Xk29fqLw77"]),
    ('#define DB_PWD "Xk29fqLw77"', ["Xk29fqLw77"]), ('<add key="Pwd" value="Xk29fqLw77"/>', ["Xk29fqLw77"]), ('pwd:\n  "Xk29fqLw77"', ["Xk29fqLw77"]),
    ("password: |\n  Xk29fqLw77\nuser: bob", ["Xk29fqLw77"]), ('pwd = (\n  "Xk29"\n  "fqLw77")', ["Xk29", "fqLw77"]), ('pwd="""Xk29fqLw77"""', ["Xk29fqLw77"]),
    ("pwd=f'Xk29fqLw77'", ["Xk29fqLw77"]), ("password:\n  host: Xk29fqLw77", [])])
def test_expressions_and_values_elsewhere(text, secrets):
    assert [text[a:b] for a, b in secret_scan.lexed(text)] == secrets


def test_constants_against_a_plain_evaluator():
    """Random programs of sums: each literal that reaches a sensitive name with a likely value is told."""
    import random

    r = random.Random(12)
    for _ in range(300):
        names, lines, values, want, at = ["a", "b", "c", "db_pwd", "authToken", "note"], [], {}, set(), 0
        for _ in range(r.randint(2, 14)):
            name, line, parts = r.choice(names), "", []
            for k in range(r.randint(1, 3)):
                line += " + " if k else f"{name} = "
                if values and r.random() < 0.5:
                    other = r.choice(sorted(values))
                    line += other
                    parts += values[other]
                else:
                    text = "".join(r.choices("abXY12-", k=r.randint(1, 7)))
                    parts = parts + [(text, (at + len(line) + 1, at + len(line) + 1 + len(text)))]
                    line += f"'{text}'"
            values[name] = parts
            score = secret_scan.name_score(name) * secret_scan.value_score("".join(t for t, _ in parts))
            if score >= secret_scan.THRESHOLD:
                want |= {span for _, span in parts}
            lines.append(line)
            at += len(line) + 1
        assert secret_scan.lexed("\n".join(lines)) == sorted(want)


def test_names_that_grow_in_every_line():
    import time

    start = time.time()
    grown = secret_scan.lexed("a = 'kkkk'\n" + "a = a + a\n" * 50_000 + "pwd = a\n")
    told = secret_scan.lexed("token = 'q1'\n" + "token = token + 'x1Yz'\n" * 50_000)
    assert not grown and len(told) == 50_001 and time.time() - start < 20


@pytest.mark.parametrize("text,expected", [
    ("Licensed under the Apache License 2.0", ["Apache-2.0"]),
    ("This project is licensed under the MIT License - see the LICENSE file for details.", ["MIT"]),
    ("Some prose. The code is dual-licensed under the MIT license (see LICENSE.txt).", ["MIT"]),
    ("Licensed under GPL-2.0-or-later", ["GPL-2.0-or-later"]),
    ("It is released under the GPLv3+", ["GPL-3.0-or-later"]),
    ("This library is distributed under the terms of the GNU Lesser General Public License, version 2.1 or later.", ["LGPL-2.1-or-later"]),
    ("Text and pictures are available under CC BY-SA 3.0.", ["CC-BY-SA-3.0"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", ["CC-BY-NC-ND-4.0"]),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["mit", "apache-2.0"]),
    ("// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause", ["gpl-2.0-only with linux-syscall-note", "bsd-3-clause"]),
    ("This is not licensed under the MIT License.", []),
    ("Licensed under the terms of our agreement.", []),
    ("Published under the sea by a mit of the GNU.", []),
])
def test_licence_references_by_name(text, expected):
    assert [f[0] for f in license_scan.scan(text)] == expected


MIT_BODY = MIT.rstrip() + "\n" + """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
GPL_TEXT = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
"""


@pytest.mark.parametrize("text,name", [(MIT_BODY, "MIT"), (GPL_TEXT, "GPL-3.0")])
@pytest.mark.parametrize("shape", [str, lambda t: t.replace("\n", "\r\n"), lambda t: t.replace("\n", "\r"), lambda t: " ".join(t.split()),
                                   lambda t: t.replace(" ", " " * 60)])
def test_whole_licences_in_any_line_ends_on_one_line_and_with_wide_spaces(text, name, shape):
    text = shape(text)
    found = license_scan.scan(text)
    assert {f[0] for f in found} == {name} and found[-1][1] == "text"
    # The whole text is taken, to its last sentence.
    assert found[-1][3] >= len(text.rstrip(" .\r\n")) - 1


def test_licence_scan_stays_linear():
    start = time.monotonic()
    for line in ("licensed under the mit license of permission is hereby granted ", "neither the name of x may endorse ", "see the " + " " * 1000 + "licence "):
        license_scan.scan(line * 5000)
        license_scan.scan((line + "\n") * 5000)
    assert time.monotonic() - start < 30
