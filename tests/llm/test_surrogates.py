"""Surrogates against a plain Python version of the permutation, coreference across spellings, and texts that strain the patterns."""

import hashlib

import pytest
import regex
from pyspark.sql import functions as F

from evidentia.llm import pii

ALPHABETS = {"name": ["aeiou", "bcdfghjklmnpqrstvwxyz", pii.ACCENTED, pii.CYRILLIC], "secret": ["0123456789abcdef"]}
PLAIN = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]


def kind_of(m):
    if "@" in m:
        return "email"
    if regex.fullmatch("[0-9a-f]{32,}|[0-9A-F]{32,}", m):
        return "secret"
    if regex.match("AKIA|gh[pousr]_|sk-", m):
        return "key"
    if regex.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        return "ip"
    if regex.fullmatch(r"[A-Z]{2}\d\d( ?[A-Z0-9]{4}){3,7}( ?[A-Z0-9]{1,3})?", m):
        return "iban"
    if regex.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        return "ssn"
    if m[0] in "+(" or regex.fullmatch(r"\d{3}[.-]\d{3}[.-]\d{4}", m):
        return "phone"
    if regex.fullmatch("[0-9 -]+", m):
        return "card"
    if regex.search("[0-9]", m):
        return "secret" if regex.fullmatch("[0-9a-f]+|[0-9A-F]+", m) else "key"
    return "name"


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + (i % 2 == 0)), 10)) for i, c in enumerate(reversed(digits)))


def surrogate(m, key):
    kind = kind_of(m)
    pre = {"phone": lambda: regex.match(pii._CALLING, m), "key": lambda: regex.match("AKIA|gh[pousr]_|sk-", m), "iban": lambda: regex.match("..", m)}.get(kind, lambda: None)()
    pre = pre.group() if pre else ""
    post = regex.search(r"\.[A-Za-z]+$", m).group() if kind == "email" else m[-1] if kind in ("name", "card") else ""
    core = m[len(pre) : len(m) - len(post)]
    bare = kind in ("phone", "card", "iban", "ssn")
    canon = regex.sub("[^0-9A-Za-z]", "", core).upper() if bare else core.lower() if kind in ("email", "secret", "name") else core
    tag = "|".join([kind, pre or ("+1" if kind == "phone" else ""), "" if kind == "card" else post.lower(), ""])
    if kind == "ip":
        cells = [(int(o) - (0, 10, 100)[len(o) - 1], (10, 90, 156)[len(o) - 1], "#" + str(len(o)), None, o) for o in canon.split(".")]
    else:
        cells = []
        for c in canon:
            a = next((a for a in ALPHABETS.get(kind, []) + PLAIN if c in a), None)
            cells.append((a.index(c), len(a), a[0], a, c) if a else (0, 1, c, None, c))
    shape = tag + "".join(c[2] for c in cells)
    half = len(cells) // 2
    left, right = [c[0] for c in cells[:half]], [c[0] for c in cells[half:]]
    sizes, others = [c[1] for c in cells[:half]], [c[1] for c in cells[half:]]
    for k in range(0, 12, 2):
        h = hashlib.sha512(f"{key}/0|{k}|{shape}|{','.join(map(str, right))}".encode()).hexdigest()
        moved = [(v + int(h[4 * (i % 31) : 4 * (i % 31) + 6], 16)) % r for i, (v, r) in enumerate(zip(left, sizes))]
        left, right, sizes, others = right, moved, others, sizes
    values = left + right
    if kind == "ip":
        return ".".join(str(v + (0, 10, 100)[len(c[4]) - 1]) for v, c in zip(values, cells))
    body = [c[3][v] if c[3] else c[4] for v, c in zip(values, cells)]
    if kind == "card":
        post = str((luhn(canon) + int(post) - luhn("".join(body))) % 10)
    out, rest = [], iter(body)
    for c in core:
        if bare and not regex.fullmatch("[0-9A-Za-z]", c):
            out.append(c)
        else:
            new = next(rest)
            up = c != c.lower() or (c == c.upper() and core == core.upper())
            out.append(new.upper() if up and kind != "key" else new)
    return pre + "".join(out) + post


def test_whole_table_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = ["Frau Anna Öztürk-Meier, call (743) 555-3824 or +44 20 7946 0958; DE89 3704 0044 0532 0130 00; SSN 123-45-6789", "password: hunter22x9 and API_KEY='Zq81-abc/DEF' Secret=0A1B2C3D4E", "4111-1111-1111-1111 from 8.8.4.4 to JOHN@Example.ORG"]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    got = {r.doc.doc_id: r for r in pii.rewritten(docs, key="a key").collect()}
    entity, seen = regex.compile(pii.ENTITY), 0
    for r in docs.collect():
        found = entity.findall(r.text or "")
        want = entity.sub(lambda m: surrogate(m.group(), "a key"), r.text or "")
        assert (got[r.doc_id].text or "") == want
        assert got[r.doc_id].n_entities == len(found) and got[r.doc_id].kinds == sorted({kind_of(m) for m in found})
        seen += len(found)
    assert seen > 20 and all(got[-i].n_entities >= 3 for i in (1, 2, 3))


def test_spellings_of_one_entity_agree(spark):
    pairs = [("mail john.smith@a.com", "mail JOHN.SMITH@A.COM"), ("at +1 (743) 555-3824", "at +1 743 555 3824"), ("at +1-743-555-3824", "at (743) 555-3824"), ("card 4111 1111 1111 1111", "card 4111111111111111"), ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000"), ("token=" + "ab12" * 10, "token=" + "AB12" * 10)]
    docs = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymized(docs, key="k").collect()}
    plain = lambda t: regex.sub("[^0-9a-z]", "", t.lower())
    for i, (a, b) in enumerate(pairs):
        x, y = got[2 * i], got[2 * i + 1]
        assert (x, y) != (a, b) and len(x) == len(a) and len(y) == len(b)
        assert plain(y) in (plain(x), plain(x).replace("1", "", 1)), (x, y)
    names = spark.createDataFrame([(1, "Mr. Smith and Mr. John Smith and MR. X"), (2, "Mrs. Smith")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.pseudonymized(names, key="k").collect()}
    first, second = regex.fullmatch(r"Mr\. (\w+) and Mr\. \w+ (\w+) and MR\. X", out[1]).groups()
    assert first == second == out[2].split()[1] != "Smith"


@pytest.mark.parametrize("text", ["x@" + "a." * 10_000 + "com 12", "a" * 300_000 + "@b.c12", "a." * 150_000 + "12", "1" * 300_000, "f" * 300_000, "sk-" + "a" * 300_000, "AB12" * 75_000, "1234 " * 60_000, "+1 " * 100_000, "Dr. A" + "a" * 300_000, "Mr. Aa " * 150_000, "password=" + "a" * 300_000 + "1", "1." * 150_000, "token=" * 50_000 + "1234567"], ids=range(14))
def test_long_texts_are_matched(spark, text):
    """A text of 300 KB that repeats the start of a pattern ends and keeps its length."""
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.pseudonymized(docs, key="k").collect()[0]
    assert len(got.text) == len(text)


def test_columns_with_our_names_pass_through(spark):
    docs = spark.createDataFrame([(1, "a@b.com", 7, 8, 9)], "doc_id long, text string, n_entities int, kinds int, doc int").withColumn("_m", F.lit(3)).withColumn("_o", F.lit(4))
    got = pii.pseudonymized(docs, key="k")
    assert got.columns == docs.columns
    assert (got.first().n_entities, got.first().kinds, got.first().doc, got.first()._m) == (7, 8, 9, 3)
    assert pii.rewritten(docs, key="k").first().n_entities == 1
