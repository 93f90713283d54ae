"""Surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern. Each has a canonical form, so that spellings of one thing agree: addresses and
hexadecimal secrets are folded to lower case, telephone, card, account and social security numbers are their digits
and letters alone (a ten-digit number without country code is one of +1), and of a person's name every part is an
entity of its own, folded, so that "Mr. Smith" and "Mr. John Smith" share their surname. The canonical form goes
through a keyed permutation of the strings of its shape: a Feistel network over its characters (octets for
IP addresses), each moving within its own alphabet. The format of the original (punctuation, blanks, letter case)
is then laid over it. So spellings of one entity agree (coreference), different entities never share a surrogate
(distinctness by construction), and length, script, vowels of names, last letter of names (gender), titles, country
codes, top-level domains, octet ranges and the validity of a card's check digit are kept. A collision check
holds the surrogates of all distinct entities against each other and against all entities of the corpus; an
entity whose surrogate collides gets one of the next nonces' that is neither an entity nor taken.

The key is a secret of the caller: who has it can undo the permutation.

Every pattern is matched in time linear in the text: it starts only where a run of its characters starts, or is of
bounded length, and no repeated group is unbounded (Java's matcher recurses on those).

Defined results: null text stays null with no entities; empty text stays empty; null ids and repeated rows
are rewritten row by row; an empty table gives no rows; other columns pass through untouched whatever their names.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, saved, table

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mister|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sra|Sr|Г-н|Г-жа)"
_TITLED = rf"(?<![\p{{L}}\p{{N}}]){_TITLE}\.? "
#: What stands before a secret that has no form of its own.
_ASSIGNED = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']? ?[=:] ?[\"']?"
PATTERNS = [
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,256}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,126}\.[A-Za-z]{2,63}",
    r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)(?![0-9A-Za-z])",
    rf"(?<={_ASSIGNED})(?=[A-Za-z_+/.-]{{0,255}}[0-9])[A-Za-z0-9_+/.-]{{8,}}+",
    rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    r"(?<![0-9A-Za-z(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"(?<![0-9A-Za-z-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])",
    rf"(?=\p{{Lu}}\p{{Ll}})(?:(?<={_TITLED})|(?<={_TITLED}\p{{Lu}}\p{{Ll}}{{1,40}} ))\p{{Lu}}\p{{Ll}}++",
]
ENTITY = "|".join(PATTERNS)
#: Texts without any of these have no entity.
HINT = rf"[0-9]{{2}}|[0-9]\.[0-9]|@|{_TITLE}\.? \p{{Lu}}|{_ASSIGNED}[A-Za-z0-9_+/.-]{{8}}|AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20}}|[0-9a-f]{{32}}|[0-9A-F]{{32}}"
#: Country calling codes of one and two digits; all others have three. (Fixed values.)
_CALLING = "[+](?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"

DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûü"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
_BARE = "('phone', 'card', 'iban', 'ssn')"


def _kind(m: str) -> str:
    return (
        f"CASE WHEN {m} LIKE '%@%' THEN 'email' WHEN {m} RLIKE '^([0-9a-f]{{32,}}|[0-9A-F]{{32,}})$' THEN 'secret'"
        f" WHEN {m} RLIKE '^(AKIA|gh[pousr]_|sk-)' THEN 'key' WHEN {m} RLIKE '^[0-9]+([.][0-9]+){{3}}$' AND length(replace({m}, '.', '')) <= 12 THEN 'ip'"
        f" WHEN {m} RLIKE '^[A-Z]{{2}}[0-9]{{2}}( ?[A-Z0-9]{{4}}){{3,7}}( ?[A-Z0-9]{{1,3}})?$' THEN 'iban' WHEN {m} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'ssn'"
        f" WHEN {m} RLIKE '^[+(]|^[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}$' THEN 'phone' WHEN {m} RLIKE '^[0-9 -]+$' THEN 'card'"
        f" WHEN {m} RLIKE '^([0-9a-f]+|[0-9A-F]+)$' AND {m} RLIKE '[0-9]' THEN 'secret' WHEN {m} RLIKE '[0-9]' THEN 'key' ELSE 'name' END"
    )


def _alphabet(kind: str, c: str) -> str:
    """SQL for the alphabet a character moves in; '' keeps it."""
    cases = [f"WHEN {kind} = 'secret' THEN '{HEX}'"]
    for a in (VOWELS, CONSONANTS, VOWELS.upper(), CONSONANTS.upper(), ACCENTED, CYRILLIC, CYRILLIC.upper()):
        cases.append(f"WHEN {kind} = 'name' AND instr('{a}', {c}) > 0 THEN '{a}'")
    for a in (DIGITS, LOWER, UPPER):
        cases.append(f"WHEN instr('{a}', {c}) > 0 THEN '{a}'")
    return f"CASE {' '.join(cases)} ELSE '' END"


_DOUBLED = "aggregate(transform(reverse(split({d}, '')), (c, i) -> CASE WHEN c = '' THEN 0 WHEN i % 2 = 0 THEN 2 * int(c) - IF(int(c) > 4, 9, 0) ELSE int(c) END), 0, (a, x) -> a + x)"


def _quoted(key: str) -> str:
    return "'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: SQL stages from an array of matches to an array of structs with the canonical form. Each reads `x` of the array before it.
_FORMS = [
    f"transform({{0}}, m -> named_struct('m', m, 'kind', {_kind('m')}))",
    f"transform({{0}}, x -> named_struct('m', x.m, 'kind', x.kind, 'pre', CASE x.kind WHEN 'phone' THEN regexp_extract(x.m, '^{_CALLING}', 0) WHEN 'iban' THEN substr(x.m, 1, 2)"
    " WHEN 'key' THEN regexp_extract(x.m, '^(AKIA|gh[pousr]_|sk-)', 0) ELSE '' END, 'post', CASE x.kind WHEN 'email' THEN regexp_extract(x.m, '[.][A-Za-z]+$', 0) WHEN 'name' THEN right(x.m, 1) WHEN 'card' THEN right(x.m, 1) ELSE '' END))",
    "transform({0}, x -> named_struct('m', x.m, 'kind', x.kind, 'pre', x.pre, 'post', x.post, 'core', substr(x.m, length(x.pre) + 1, length(x.m) - length(x.pre) - length(x.post))))",
    f"transform({{0}}, x -> named_struct('m', x.m, 'kind', x.kind, 'pre', x.pre, 'post', x.post, 'core', x.core, 'canon', CASE WHEN x.kind IN {_BARE} THEN upper(regexp_replace(x.core, '[^0-9A-Za-z]', '')) WHEN x.kind IN ('email', 'secret', 'name') AND length(lower(x.core)) = length(x.core) THEN lower(x.core) ELSE x.core END,"
    " 'tag', concat(x.kind, '|', IF(x.kind = 'phone' AND x.pre = '', '+1', x.pre), '|', IF(x.kind = 'card', '', lower(x.post)), '|')))",
]
_OWN = "'m', x.m, 'kind', x.kind, 'pre', x.pre, 'post', x.post, 'core', x.core, 'canon', x.canon, 'tag', x.tag"


def _moves(secret: str) -> list[str]:
    """SQL stages that add `body`, the permuted canonical form. `secret` is SQL for the key."""
    units = f"IF(x.kind = 'ip', transform(split(x.canon, '[.]'), t -> named_struct('t', t, 'a', '', 'v', int(t) - CASE length(t) WHEN 1 THEN 0 WHEN 2 THEN 10 ELSE 100 END, 'r', CASE length(t) WHEN 1 THEN 10 WHEN 2 THEN 90 ELSE 156 END)), transform(filter(split(x.canon, ''), t -> t <> ''), t -> named_struct('t', t, 'a', {_alphabet('x.kind', 't')}, 'v', 0, 'r', 1)))"
    settled = "transform(x.u, t -> IF(t.a = '', t, named_struct('t', t.t, 'a', t.a, 'v', instr(t.a, t.t) - 1, 'r', length(t.a))))"
    shape = "concat(x.tag, array_join(transform(x.u, t -> IF(t.r = 1, t.t, IF(t.a = '', concat('#', length(t.t)), substr(t.a, 1, 1)))), ''))"
    half = "int(size(x.u) / 2)"
    start = f"named_struct('l', slice(transform(x.u, t -> t.v), 1, {half}), 'r', slice(transform(x.u, t -> t.v), {half} + 1, size(x.u)), 'p', slice(transform(x.u, t -> t.r), 1, {half}), 'q', slice(transform(x.u, t -> t.r), {half} + 1, size(x.u)), 'h', '')"
    # even steps hash the right half, odd steps move the left half by it and change sides
    step = (
        f"(s, k) -> IF(k % 2 = 0, named_struct('l', s.l, 'r', s.r, 'p', s.p, 'q', s.q, 'h', sha2(concat({secret}, '|', k, '|', x.shape, '|', array_join(s.r, ',')), 512)),"
        " named_struct('l', s.r, 'r', transform(s.l, (v, i) -> pmod(v + int(conv(substr(s.h, 1 + 4 * pmod(i, 31), 6), 16, 10)), s.p[i])), 'p', s.q, 'q', s.p, 'h', s.h))"
    )
    moved = f"aggregate(sequence(0, 11), {start}, {step}, s -> concat(s.l, s.r))"
    written = "array_join(transform(x.u, (t, i) -> CASE WHEN t.r = 1 THEN t.t WHEN t.a = '' THEN string(x.w[i] + CASE length(t.t) WHEN 1 THEN 0 WHEN 2 THEN 10 ELSE 100 END) ELSE substr(t.a, x.w[i] + 1, 1) END), IF(x.kind = 'ip', '.', ''))"
    return [
        f"transform({{0}}, x -> named_struct({_OWN}, 'u', {units}))",
        f"transform({{0}}, x -> named_struct({_OWN}, 'u', {settled}))",
        f"transform({{0}}, x -> named_struct({_OWN}, 'u', x.u, 'shape', {shape}))",
        f"transform({{0}}, x -> named_struct({_OWN}, 'u', x.u, 'w', {moved}))",
        f"transform({{0}}, x -> named_struct({_OWN}, 'body', {written}))",
    ]


#: SQL stages from the array with `body` to one of (kind, sur): the original's format laid over the body. Entities that
#: have a bare form are short; those of any length are laid over place by place.
_PLACED = "IF(t <> lower(t) OR (x.upper AND t = upper(t)), upper({c}), {c})"
_CHECK = f"string(pmod({_DOUBLED.format(d='x.canon')} + int(x.post) - {_DOUBLED.format(d='x.body')}, 10))"
_LAID = [
    "transform({0}, x -> named_struct('kind', x.kind, 'pre', x.pre, 'canon', x.canon, 'core', filter(split(x.core, ''), t -> t <> ''), 'upper', x.core = upper(x.core), 'body', x.body, 'b', IF(x.kind IN ('key', 'ip'), array(''), filter(split(x.body, ''), t -> t <> '')), 'post', x.post))",
    f"transform({{0}}, x -> named_struct('kind', x.kind, 'sur', concat(x.pre, CASE WHEN x.kind IN ('key', 'ip') THEN x.body WHEN x.kind IN {_BARE} THEN aggregate(x.core, named_struct('s', '', 'k', 0), (a, t) ->"
    f" IF(NOT t RLIKE '[0-9A-Za-z]', named_struct('s', concat(a.s, t), 'k', a.k), named_struct('s', concat(a.s, {_PLACED.format(c='x.b[a.k]')}), 'k', a.k + 1)), a -> a.s)"
    f" ELSE array_join(transform(x.core, (t, i) -> {_PLACED.format(c='x.b[i]')}), '') END, IF(x.kind = 'card', {_CHECK}, x.post))))",
]


def _staged(df: DataFrame, column: str, stages: list[str], out: str) -> DataFrame:
    for i, sql in enumerate(stages):
        df = df.withColumn(f"{out}{i}", F.expr(sql.replace("{0}", column)))
        column = f"{out}{i}"
    return df.withColumnRenamed(column, out)


def _matches(text_col: str):
    text = F.col(text_col)
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), 0)).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct entities of the corpus by their canonical form: kind, tag, canon."""
    found = docs.select(F.explode(F.array_distinct(_matches(text_col))).alias("_e")).distinct().select(F.array("_e").alias("_m"))
    return _staged(found, "_m", _FORMS, "_x").select(F.col("_x")[0].alias("x")).select("x.kind", "x.tag", "x.canon").distinct()


def _moved(found: DataFrame, secret: str) -> DataFrame:
    """found with `sur`, the permuted canonical forms."""
    one = F.struct(F.lit("").alias("m"), "kind", F.lit("").alias("pre"), F.lit("").alias("post"), F.lit("").alias("core"), "canon", "tag")
    return _staged(found.withColumn("_one", F.array(one)), "_one", _moves(secret), "_s").withColumn("sur", F.col("_s")[0]["body"])


def _values(kind: str, canon: str) -> str:
    """SQL for a bound of the number of values of an entity's shape."""
    return f"aggregate(filter(split({canon}, ''), t -> t <> ''), 1.0D, (a, t) -> a * greatest(1, length({_alphabet(kind, 't')})))"


def collided(ws: Workspace, found: DataFrame, key: str, width: int = 16) -> DataFrame | None:
    """tag, canon, sur of the entities whose own surrogate is an entity of the corpus or another's; None if there are none.

    Each takes the first surrogate of the further nonces that is no entity and not taken; the number of nonces tried
    at once doubles until all have one. Only where more nonces were tried than 64 times the values
    of an entity's shape is none of them free (all are entities or taken); it then keeps its own surrogate.
    """
    s = ws.saved(_moved(found, _quoted(f"{key}/0")).select("kind", "tag", "canon", "sur"), "surrogates")
    real = found.select("tag", F.col("canon").alias("sur"))
    at = ["tag", "sur"]
    twice = s.groupBy(at).agg(F.count("*").alias("n"), F.min("canon").alias("first")).filter("n > 1")
    again = s.join(twice, at).filter("canon <> first").select("kind", "tag", "canon")
    left = ws.saved(s.join(real, at, "left_semi").select("kind", "tag", "canon").union(again).distinct(), "collided")
    if left.isEmpty():
        return None
    taken = s.join(left, ["tag", "canon"], "left_anti").select(at)
    done, start = None, 1
    while not left.isEmpty():
        tried = _moved(left.select("kind", "tag", "canon", F.explode(F.sequence(F.lit(start), F.lit(start + width - 1))).alias("n")), f"concat({_quoted(key + '/')}, n)")
        tried = tried.select("tag", "canon", "n", "sur").join(real, at, "left_anti").join(taken, at, "left_anti")
        won = tried.groupBy(at).agg(F.min(F.struct("n", "canon")).alias("w")).groupBy("tag", "w.canon").agg(F.min(F.struct("w.n", "sur")).alias("v"))
        won = ws.saved(won.select("tag", "canon", F.col("v.sur").alias("sur")), "resolved")
        done = won if done is None else done.unionByName(won)
        taken = taken.union(won.select(at))
        start, width = start + width, 2 * width
        left = ws.saved(left.join(won, ["tag", "canon"], "left_anti").filter(f"64 * {_values('kind', 'canon')} > {start}").select("kind", "tag", "canon"), "collided")
    return done


def rewritten(docs: DataFrame, text_col: str = "text", *, key: str) -> DataFrame:
    """doc (the row as a struct, as given), text (the new text), n_entities, kinds (sorted) for every row.

    Each part of a person's name counts as an entity.
    """
    ws = Workspace(docs.sparkSession, "pii")
    other = collided(ws, ws.saved(entities(docs, text_col), "entities"), key)
    t = docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("_t"), _matches(text_col).alias("_m"))
    t = _staged(t, "_m", _FORMS, "_f")
    if other is not None:
        # by the documents' arrays of entities, so that only those with such an entity are grouped
        lists = _staged(docs.select(_matches(text_col).alias("_m")).filter(F.size("_m") > 0), "_m", _FORMS, "_f")
        ids = F.array_distinct(F.transform("_f", lambda x: F.struct(x["tag"].alias("tag"), x["canon"].alias("canon"))))
        lists = lists.select("_m", F.explode(ids).alias("i")).select("_m", "i.*").join(other, ["tag", "canon"])
        lists = lists.groupBy("_m").agg(F.map_from_entries(F.collect_set(F.struct(F.concat("tag", "canon"), "sur"))).alias("_o"))
        # outside the workspace: the result reads it when it is used
        t = t.join(saved(lists, "pii-lists"), "_m", "left")
    t = _staged(t, "_f", _moves(_quoted(f"{key}/0")), "_s")
    if other is not None:
        t = t.withColumn("_s", F.transform("_s", lambda s: s.withField("body", F.coalesce(F.element_at("_o", F.concat(s["tag"], s["canon"])), s["body"]))))
    t = _staged(t, "_s", _LAID, "_z")
    gaps = F.split("_t", ENTITY, -1)
    text = F.when(F.size("_m") > 0, F.array_join(F.zip_with(gaps, "_z", lambda g, s: F.concat(F.coalesce(g, F.lit("")), F.coalesce(s["sur"], F.lit("")))), "")).otherwise(F.col("_t"))
    out = t.select("doc", text.alias("text"), F.size("_m").alias("n_entities"), F.array_sort(F.array_distinct(F.transform("_z", lambda s: s["kind"]))).alias("kinds"))
    ws.close()
    return out


def pseudonymized(docs: DataFrame, text_col: str = "text", *, key: str) -> DataFrame:
    """The documents with every entity replaced; columns as given."""
    t = rewritten(docs, text_col, key=key)
    return t.select(*(F.col("text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns))


def surrogate_key(spark: SparkSession) -> str:
    """The setting spark.evidentia.surrogates.key, or else a new random key: surrogates then can't be linked between runs."""
    return spark.conf.get("spark.evidentia.surrogates.key", None) or secrets.token_hex(32)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data."""
    d = rewritten(table(spark, sf_dir, "documents"), key=surrogate_key(spark))
    return d.select("doc.doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))
