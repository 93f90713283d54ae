"""Quality rules, surrogates, mixing, near duplicates, repeated passages and search against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import graphs, mixing, neardup, pii, quality, substring, topk


def test_quality_of_odd_documents(odd_docs, no_docs):
    got = quality.measured(odd_docs).select("_doc.doc_id", "_doc.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == odd_docs.count()
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        grams = defaultdict(list)
        for i in range(len(words) - 4):
            grams[tuple(words[i : i + 5])].append(i)
        again = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(again))
        assert r.base_failed == (len(words) < 10 or 100 * len(again) > 20 * len(words))
    assert quality.measured(no_docs).count() == 0
    kept = quality.clean(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "6", "6", "None"]
    assert quality.clean(no_docs).count() == 0


def test_quality_rules_by_line(spark):
    prose = "A sentence of prose that ends as it should, with a stop."
    rows = [(1, f"{prose}\nHome | About | News | Contact | Login\nThen something else is told, in other words, and it goes on."), (2, "Home | About | News | More | Other | Last | One | Two | Three | Four"), (3, f"{prose} And ten words more.\nThis work is licensed under the GNU General Public License, version 3."), (4, "BUY!! NOW!! THE!! BEST!! OF!! ALL!! THE!! DEALS!! IN!! TOWN!! TODAY!!")]
    got = {r.doc_id: r.text for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 3}
    assert "Home" not in got[1] and "licensed" not in got[3]


def test_notices_and_menus_by_language(spark):
    prose = {"en": "The river rose in spring, and the lower fields were under water for a week.", "fr": "La rivière monta au printemps, et les champs furent sous l'eau une semaine.", "de": "Der Fluss stieg im Frühling, und die Felder standen eine Woche unter Wasser.", "es": "El río creció en primavera, y los campos estuvieron una semana bajo el agua."}
    notices = {"en": ["All rights reserved.", "Read our privacy policy before you go on to the next of these pages, please."], "fr": ["Tous droits réservés.", "MENTIONS LÉGALES et politique de confidentialité de ce site, pour tous ses lecteurs."], "de": ["Alle Rechte vorbehalten.", "Lesen Sie unsere Datenschutzerklärung, bevor Sie auf dieser Seite weiter lesen wollen."], "es": ["Todos los derechos reservados.", "POLÍTICA DE COOKIES y aviso legal de esta página, para todos los que la leen hoy."]}
    menu = "Home\nAbout\nContact us\nNews and press\nLog in"
    rows = []
    for k, lang in enumerate(prose):
        n = "\n".join(notices[lang])
        rows += [(10 * k, f"{prose[lang]}\n{n}"), (10 * k + 1, n), (10 * k + 2, f"{menu}\n{prose[lang]}"), (10 * k + 3, "\n".join([menu] * 3)), (10 * k + 4, f"One\nTwo\n{prose[lang]}")]
    got = {r.doc_id: r.text for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, lang in enumerate(prose):
        assert got[10 * k] == got[10 * k + 2] == prose[lang] and got[10 * k + 4].startswith("One\nTwo\n")
        assert 10 * k + 1 not in got and 10 * k + 3 not in got


def test_surrogates(spark, odd_docs, no_docs):
    texts = ["a jane.doe42@mail.example.com b, 10.0.0.255. and +1 (743) 555-3824 x", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" 4111111111111111', "Mrs. Smith met Mr Jones; Mrs. Smith again. Г-н Иванов", "DE89 3704 0044 0532 0130 00 and 123-45-6789", "jane.doe42@mail.example.com", "none 12 here 2020-11-11"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc.doc_id: r for r in pii.rewritten(docs, key="k").collect()}
    for i, t in enumerate(texts):
        new = out[i].text
        assert len(new) == len(t) and re.sub(r"\w", "w", new) == re.sub(r"\w", "w", t)
    assert "jane" not in out[0].text and "10.0.0.255" not in out[0].text and "555-3824" not in out[0].text and "24be" not in out[1].text and "4111111111111111" not in out[1].text
    mail = re.search(r"\S+@\S+", out[0].text).group()
    assert mail == out[4].text and mail.endswith(".com")
    names = re.findall(r"Mrs\. (\w+)", out[2].text)
    assert names[0] == names[1] != "Smith" and names[0][-1] == "h" and re.search("Г-н [А-Я][а-я]+", out[2].text) and "Иванов" not in out[2].text
    card = re.search(r"\d{16}", out[1].text).group()
    assert sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(card))) % 10 == 0
    assert all(int(x) <= 255 for x in re.search(r"\d+\.\d+\.\d+\.\d+", out[0].text).group().split("."))
    assert out[5].text == texts[5] and out[5].n_entities == 0
    other = {r.doc_id: r.text for r in pii.pseudonymized(docs, key="else").collect()}
    assert other[4] != out[4].text
    odd = pii.pseudonymized(odd_docs, key="k")
    assert odd.columns == odd_docs.columns
    assert sorted(str((r.doc_id, len(r.text or ""), r.text is None)) for r in odd.collect()) == sorted(str((r.doc_id, len(r.text or ""), r.text is None)) for r in odd_docs.collect())
    assert pii.pseudonymized(no_docs, key="k").count() == 0


def test_surrogates_are_distinct(spark):
    cards = spark.range(3000).selectExpr("id AS doc_id", "lpad(cast(id AS string), 13, '0') AS text")
    got = [r.text for r in pii.pseudonymized(cards, key="k").collect()]
    assert len(set(got)) == 3000


def test_mixing(spark, odd_docs, no_docs):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 80)), s) for i, s in enumerate(["a"] * 400 + ["b"] * 300 + ["c"] * 4 + [None] * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.decided(docs).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= 3
    total = sum(size.values())
    weight, want, open_ = {"a": 1, "b": 2, "c": 3, None: 1}, {}, {"a", "b", "c", None}
    while open_:
        level = (total - sum(want.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not over:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 3 * size[s] for s in over}
        open_ -= over
    for s in size:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert taken[s] == pytest.approx(want[s], rel=0.01, abs=80)
    again = mixing.decided(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.decided(odd_docs).count() == odd_docs.count()
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns and out.count() > 0
    assert mixing.decided(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_rows_that_repeat_take_the_copies_decided(spark):
    rng = random.Random(6)
    rows = [(i % 40, " ".join(["w"] * (1 + i % 40)), "ab"[i % 40 % 2], i) for i in range(400)] + [(None, " ".join(["w"] * rng.randrange(1, 9)), None, i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _src int").withColumn("copies", F.lit(5)).withColumn("least", F.lit(6))
    want = defaultdict(int)
    for r in mixing.decided(docs).collect():
        want[r.source] += r.copies * r.size
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.source] += len(r.text.split())
    assert got == {s: n for s, n in want.items() if n}


def _components(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    comp = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y) and comp[a] != comp[b]:
                lo, hi = sorted((comp[a], comp[b]))
                comp = {k: lo if v == hi else v for k, v in comp.items()}
    return comp, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(60)) for _ in range(150)] for _ in range(6)]
    texts, i = {}, 0
    for b in base:
        for edits in [0, 0, 1, 1, 2, 2, 3, 4, 5, 6, 8, 10, 20] * 2:
            w = list(b)
            for _ in range(edits):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(10**6))
            texts[i] = " ".join(w)
            i += 1
    texts |= {i: None, i + 1: "", i + 2: "One two", i + 3: "one TWO", i + 4: "one"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, sizes = _components(texts, 3, 85)
    for block in (500_000, 800):
        got = neardup.near_duplicates(docs, shingle=3, percent=85, block_shingles=block).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert {r.doc_id: r.n_shingles for r in got} == sizes


def test_large_groups_keep_all_links(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = {}
    for i in range(700):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**9)}"
        texts[i] = " ".join(w)
    want, _ = _components(texts, 3, 85)
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle=3, percent=85)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_near_duplicates_of_odd_documents(odd_docs, no_docs):
    got = neardup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {(r.doc_id, r.component_id) for r in got}
    assert (6, 1) in by and (1, 1) in by and (2, 2) in by and (3, 3) in by and (None, None) in by
    left = neardup.deduplicated(odd_docs)
    assert left.columns == odd_docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "4", "5", "7", "None", "None"]
    assert neardup.near_duplicates(no_docs).count() == 0 and neardup.deduplicated(no_docs).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200) if i % 50] + [(300, 7), (7, 300), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in graphs.components(links).collect()}
    assert got == {n: max(1, 50 * ((n - 1) // 50) + 1) for n in range(1, 201)} | {300: 1}
    assert graphs.components(links.limit(0)).count() == 0


def _kept(texts, window):
    first, words = {}, {i: (t or "").encode().split() for i, t in texts.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_passages_against_brute_force(spark):
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    shared, texts = [words(70), words(49), words(120)], {}
    for i in range(60):
        w = words(rng.randrange(0, 200))
        for s in rng.sample(shared, rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = s
        texts[i] = " ".join(w)
    texts |= {60: None, 61: "", 62: texts[3], 63: " ".join(["x"] * 300), 64: " ".join(["x"] * 200)}
    want = _kept(texts, 50)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for load in (400_000, 400, 20):  # one index, many, and minimizers whose windows are told apart one by one
        got = substring.without_repeats(docs, shard_words=load).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_repeated_passages_of_odd_documents(odd_docs, no_docs):
    got = substring.without_repeats(odd_docs, window=5, gram=3, with_text=True).collect()
    assert len(got) == odd_docs.count()
    assert {(r.doc_id, r.n_removed) for r in got if r.doc_id in (1, 2, 3, 6)} == {(1, 0), (2, 0), (3, 0), (6, 14)}
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert substring.without_repeats(no_docs).count() == 0


def test_word_index_finds_what_is_there():
    rng = np.random.RandomState(4)
    text = rng.randint(1, 6, 500)
    text[rng.randint(0, 500, 10)] = 0
    index = substring.WordIndex(text)
    for size in (1, 2, 5):
        starts = np.array([i for i in range(500 - size) if 0 not in text[i : i + size]])
        length, lo, hi = index.matching_statistics(text, starts + size, size, np.ones(len(starts), np.int64))
        assert (length == size).all()
        for s, a, b in zip(starts, lo, hi):
            there = [i for i in range(501 - size) if (text[i : i + size] == text[s : s + size]).all()]
            assert sorted(index.order[a:b].tolist()) == there


def test_matching_statistics_of_a_shard_file():
    """Against brute force: how far back from each place the words occur twice, and the smallest document of a window."""
    rng = np.random.RandomState(5)
    words = [rng.randint(1, 4, n).astype(np.uint64) for n in (60, 40, 30)]
    docs = np.array([7, 3, 9])
    shard = substring.Shard(substring.Shard.built(words, docs))
    joined = [w.tolist() for w in words]
    count = lambda run: sum(w[i : i + len(run)] == run for w in joined for i in range(len(w) - len(run) + 1))
    coded = np.searchsorted(shard.names, words[0]) + 1
    ends = np.arange(12, 61)
    length, lo, hi = shard.index.matching_statistics(coded, ends, 12, np.full(len(ends), 2))
    for e, n, a, b in zip(ends, length, lo, hi):
        want = max(k for k in range(13) if k == 0 or count(joined[0][e - k : e]) >= 2)
        assert n == want and (n == 0 or b - a == count(joined[0][e - n : e]))
    for w, d, first in zip(joined, docs, shard.first_documents(words, docs, 6, True)):
        for i, got in enumerate(first):
            assert got == min(x for v, x in zip(joined, docs) if any(v[k : k + 6] == w[i : i + 6] for k in range(len(v) - 5)))


def test_top_k_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.5))) for _ in range(24)]) for i in range(300)]
    rows += [(300, None), (301, [None] * 24), (302, [float("nan")] * 24), (303, [float("inf")] * 24), (304, rows[0][1]), (305, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]), (306, []), (320, [0.5] * 7), (321, [0.5] * 7)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS score")
    got = topk.top_k(v.filter("vec_id % 20 = 0"), v, k=5, block=64, probe=40).collect()
    ok = [(i, tuple(int(np.floor(64 * x)) for x in e)) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    want = set()
    for q, a in {(i, e) for i, e in ok if i % 20 == 0}:
        best = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(b) == len(a)))[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got if r.query_id != 0} == {w for w in want if w[0] != 0}
    assert topk.top_k(v.limit(0), v).count() == 0 and topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [float((i * 7919 + k) % 100_003) * 1e6 for k in range(8)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in topk.top_k(v.filter("vec_id = 20"), v, k=3).collect():
        a, b = rows[20][1], rows[r.vec_id][1]
        assert r.score == sum(int(64 * x) * int(64 * y) for x, y in zip(a, b))


def _parts(n, edges):
    label = list(range(n))
    for a, b in edges:
        x, y = label[a], label[b]
        label = [y if v == x else v for v in label]
    return {tuple(i for i in range(n) if label[i] == v) for v in label}


def test_spanning_edges_connect_as_all_links_do():
    """Chains and bridged clumps in random order: rows left out under one component aren't lost when another grows larger."""
    cases = [(5, 0, [(0, 1), (1, 3), (2, 3), (2, 4)])]
    draw = random.Random(7)
    for case in range(300):
        n = draw.randrange(5, 60)
        rows = draw.sample(range(n), n)
        if case % 2:
            links = [(rows[i], rows[i + 1]) for i in range(n - 1) if draw.random() < 0.9]
        else:
            clumps = [rows[i : i + 7] for i in range(0, n, 7)]
            links = [(x, y) for c in clumps for x in c for y in c if x < y and draw.random() < 0.6]
            links += [(draw.choice(a), draw.choice(b)) for a, b in zip(clumps, clumps[1:]) if draw.random() < 0.7]
        cases.append((n, draw.randrange(n), links))
    for n, centre, links in cases:
        near = defaultdict(set)
        for a, b in links:
            near[a].add(b)
            near[b].add(a)
        got = neardup.spanning(n, lambda i: np.array(sorted(near[i]), np.int64), centre)
        assert _parts(n, got) == _parts(n, links)
        assert len(got) == n - len(_parts(n, links))


def test_chains_of_links_stay_whole(spark):
    """150 groups of 12 texts, each a chain whose neighbours alone are linked (92 of 108 shingles shared)."""
    rng = random.Random(12)
    texts = {}
    ids = rng.sample(range(10_000), 1800)
    for g in range(150):
        words = [f"g{g}w{k}" for k in range(102 + 8 * 11)]
        for k in range(12):
            texts[ids[12 * g + k]] = " ".join(words[8 * k : 8 * k + 102])
    want = {i: min(ids[12 * g : 12 * g + 12]) for g in range(150) for i in ids[12 * g : 12 * g + 12]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (40_000, 250):
        got = neardup.near_duplicates(docs, shingle=3, percent=85, block_shingles=block).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_a_cluster_of_several_components(spark, monkeypatch):
    """A large cluster that isn't one component: its rest is held against all blocks."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    texts = {}
    for i in range(240):  # groups at 0.70 to 0.99 of each other, all within the signatures' tolerance
        w = list(base)
        for k in range(0, 5 * (i % 4), 1):
            w[10 + 6 * k % 90] = f"v{i % 4}x{k}"
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**9)}"
        texts[i] = " ".join(w)
    want, _ = _components(texts, 3, 85)
    assert len(set(want.values())) > 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (40_000, 2_000, 300):
        got = neardup.near_duplicates(docs, shingle=3, percent=85, block_shingles=block).collect()
        assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("hot", [1, 20])
def test_hot_first_pieces_are_matched_whole(spark, hot):
    """Rows of first pieces over the counted size are dealt by both pieces; no pair of a bucket is left out."""
    rng = random.Random(9)
    texts = {}
    for _ in range(5):
        base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        for _ in range(24):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**9)}"
            texts[len(texts)] = " ".join(w)
    want, _ = _components(texts, 3, 85)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = neardup.near_duplicates(docs, shingle=3, percent=85, hot=hot)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_every_pattern_is_found_alone(spark):
    """One entity of each pattern, alone in its text and without adjacent digits where the pattern allows that."""
    alone = ["a.b@c.org", "a1b2c3d4" * 4, "A1B2C3D4" * 4, "abcdefab" * 4, "AKIA" + "Q7ZB" * 4, "AKIA" + "QWERTZUI" * 2, "ghp_" + "aB3d" * 9, "gho_" + "abcD" * 9, "sk-" + "x9Yz" * 8, "sk-" + "abcdE" * 4, "1.2.3.4", "GB29 NWBK AAAA BBBB CCCC", "+1 555 0100 200", "(212) 555-0100", "212-555-0100", "123-45-6789", "4111 1111 1111 1111", "4111111111111111", "Dr. Smith", "Г-н Иванов"]
    docs = spark.createDataFrame(list(enumerate(alone)), "doc_id long, text string")
    got = {r.doc.doc_id: r for r in pii.rewritten(docs, key="k").collect()}
    assert [(alone[i], got[i].n_entities, got[i].text != alone[i]) for i in got] == [(alone[i], 1, True) for i in got]


def test_surrogates_are_no_real_values_of_a_dense_corpus(spark):
    """A third of a small shape's values are real: no nonce is free of collisions, each entity still gets a value that isn't real."""
    ips = [f"{a}.{b}.{c}.7" for a in range(10) for b in range(10) for c in range(10)] + [f"{a}.{b}.{c}.3" for a in range(10) for b in range(10) for c in range(10)]
    ips = ips + [f"{a}.{b}.{c}.5" for a in range(10) for b in range(10) for c in range(10)]
    texts = [f"from {i} and {i} to {j}." for i, j in zip(ips, ips[1:] + ips[:1])]
    got = [r.text for r in pii.pseudonymized(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), key="k").orderBy("doc_id").collect()]
    seen = {}
    for old, new in zip(texts, got):
        for x, y in zip(re.findall(r"[0-9.]+[0-9]", old), re.findall(r"[0-9.]+[0-9]", new)):
            assert seen.setdefault(x, y) == y
    assert len(seen) == len(set(seen.values())) == 3000 and not set(seen) & set(seen.values())


def test_surrogates_of_a_full_shape_stay_distinct(spark):
    texts = [f"Mr {v}b" for v in "AEIOU"] + ["Dr. Wu"]
    got = [r.text for r in pii.pseudonymized(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k").orderBy("doc_id").collect()]
    assert len(set(got)) == len(texts) and got[5] != "Dr. Wu"


def test_links_between_blocks_connect_as_all_links_do():
    draw = random.Random(21)
    for case in range(300):
        percent = draw.choice([50, 70, 85])
        base = draw.sample(range(1000), 40)
        rows = [sorted(set(base[: draw.randrange(1, 41)] if draw.random() < 0.3 else [w if draw.random() < draw.choice([0.8, 0.9, 0.99]) else draw.randrange(1000) for w in base])) for _ in range(draw.randrange(2, 40))]
        n = len(rows)
        side = [draw.randrange(2) for _ in rows]
        linked = lambda i, j: 100 * len({*rows[i]} & {*rows[j]}) >= percent * len({*rows[i]} | {*rows[j]})
        inside = [(i, j) for i in range(n) for j in range(i) if side[i] == side[j] and linked(i, j)]
        across = [(i, j) for i in range(n) for j in range(i) if side[i] != side[j] and linked(i, j)]
        blocks = []
        for s in range(2):
            ids = np.array([i for i in range(n) if side[i] == s], np.int64)
            label = neardup._labels(ids, [e for e in inside if side[e[0]] == s])
            sets = [np.array(rows[i], np.uint64) for i in ids]
            blocks.append(neardup.Block.built(ids, label, np.array([len(x) for x in sets], np.int64), np.concatenate([*sets, np.zeros(0, np.uint64)])))
        got = neardup.cross_edges(*blocks, percent)
        assert {(max(e), min(e)) for e in got} <= set(across)
        assert _parts(n, inside + got) == _parts(n, inside + across)
        assert len(got) == len(_parts(n, inside)) - len(_parts(n, inside + across))


def test_a_cluster_is_not_copied_for_its_rest(spark):
    """Edited copies of a text, most of them linked with none: with four times the rows, what is shuffled grows by about as much, not by the square."""
    rng = random.Random(14)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    texts = {}
    for i in range(800):
        w = list(base)
        for k in rng.sample(range(100), rng.randrange(12)):
            w[k] = f"n{rng.randrange(10**9)}"
        texts[i] = " ".join(w)
    written = []
    for n in (200, 800):
        some = {i: texts[i] for i in range(n)}
        want, _ = _components(some, 3, 85)
        assert n / 4 < len(set(want.values())) < n
        docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
        before = spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
        got = neardup.near_duplicates(docs, shingle=3, percent=85, block_shingles=300).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        written.append(spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite() - before)
    print("shuffled:", written)
    assert written[1] < 8 * written[0]
