"""Whitening, prefix trie and quality rules against plain versions."""

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from odd_tables import CLASHING
from pyspark.sql import functions as F

from sigspark.llm import prefix_trie, quality_rules, queries, whitening

# --- whitening ---

VECTOR_FIELDS = "vec_id long, embedding array<float>, label int, " + ", ".join(f"`{c}` string" for c in ["x", "n", "deviation", "component", *CLASHING])
SPARE = ["clash"] * (len(CLASHING) + 4)


def plain_whitening(vectors):
    """Integers, covariance and squared deviations by plain arithmetic."""
    dims = max(map(len, vectors))
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] + [1_000_000] * (dims - len(v)) for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    apart = [[n * c - s for c, s in zip(row, sums)] for row in x]
    v = np.array([[sum(a[i] * a[j] for a in apart) / n**3 for j in range(dims)] for i in range(dims)])
    return [sum(a * a for a in row) for row in apart], np.array([[a / n for a in row] for row in apart]), v


def held_to_plain(rows, vectors):
    deviations, centred, v = plain_whitening([x for _, x in vectors])
    values = np.linalg.eigvalsh(v)[::-1]
    got = defaultdict(list)
    for r in rows:
        got[r["vec_id"], int(r["deviation"])].append((r["component"], r["whitened"], r["explained"], r["n"], r["identity_error"]))
    assert Counter((i, d) for (i, d), found in got.items() for _ in range(len(found) // len({f[0] for f in found}))) == Counter(zip([i for i, _ in vectors], deviations))
    k = max(r["component"] for r in rows)
    assert k == min(32, int((values > 1e-13 * values[0]).sum()))
    for r in rows:
        assert r["n"] == len(vectors) and r["identity_error"] < 1e-4
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-6)
    # the rows' inner products over all components are those of the centred vectors in the metric of the covariance
    if k == len(v):
        first = {key: np.array([w for _, w, *_ in sorted(found)[: k]]) for key, found in got.items() if len(found) == k}
        for (i, d), z in list(first.items())[:20]:
            at = [a for a, (j, _) in enumerate(vectors) if j == i and deviations[a] == d][0]
            assert z @ z == pytest.approx(centred[at] @ np.linalg.solve(v, centred[at]), rel=1e-6)


def test_whitening_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(6)]) for i in range(150)]
    rows += [(150, None), (151, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (152, [float("nan")] * 6), (153, [float("inf")] + [0.0] * 5)]
    rows += [(154, [0.5, -0.25]), (155, []), (None, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (3, rows[3][1]), (7, rows[8][1]), (160, [-300.0, 20000.5, 0.0, 0.0, 1.0, 0.1])]
    df = spark.createDataFrame([(i, v, 0, *SPARE) for i, v in rows], VECTOR_FIELDS).repartition(5)
    bad = lambda v: v is None or any(c is None or not np.isfinite(c) for c in v)
    held_to_plain(whitening.whitened_table(df).collect(), [(i, v) for i, v in rows if not bad(v)])


def test_whitening_without_variance(spark):
    none = spark.createDataFrame([], VECTOR_FIELDS)
    assert whitening.whitened_table(none).count() == 0
    same = spark.createDataFrame([(i, [0.5, 0.25], 0, *SPARE) for i in range(4)], VECTOR_FIELDS)
    assert whitening.whitened_table(same).count() == 0
    flat = spark.createDataFrame([(i, [0.5, i / 8, i / 4], 0, *SPARE) for i in range(9)], VECTOR_FIELDS)
    found = whitening.whitened_table(flat).collect()
    assert {r["component"] for r in found} == {1} and found[0]["identity_error"] < 1e-12 and found[0]["explained"] == pytest.approx(1)


def determinant(m):
    m, out = [row[:] for row in m], Fraction(1)
    for i in range(len(m)):
        out *= m[i][i]
        for r in range(i + 1, len(m)):
            share = m[r][i] / m[i][i]
            m[r] = [a - share * b for a, b in zip(m[r], m[i])]
    return out


def test_whitening_of_badly_scaled_dimensions(spark):
    """The least eigenvalue is a 10^14th of the largest: too little for double precision, whose noise would be as large."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 3e5), rng.gauss(0, 1e3) + 5e4, rng.gauss(0, 1), rng.gauss(0, 0.05)]) for i in range(300)]
    df = spark.createDataFrame([(i, v, 0, *SPARE) for i, v in rows], VECTOR_FIELDS)
    found = whitening.whitened_table(df).collect()
    assert {r["component"] for r in found} == {1, 2, 3, 4} and found[0]["identity_error"] < 1e-6
    x = [[int(np.floor(64 * float(np.float32(c)))) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    apart = [[300 * c - s for c, s in zip(row, sums)] for row in x]
    v = [[Fraction(sum(a[i] * a[j] for a in apart), 300**3) for j in range(4)] for i in range(4)]
    explained = {r["component"]: r["explained"] for r in found}
    assert float(np.prod([*explained.values()])) * float(sum(v[i][i] for i in range(4))) ** 4 == pytest.approx(float(determinant(v)), rel=1e-6)


@pytest.mark.parametrize("bits,rows", [(1, 1), (5, 63), (8, 64), (13, 200), (40, 130), (64, 70)])
def test_scatter_is_exact(monkeypatch, bits, rows):
    monkeypatch.setattr(whitening, "PLANE_BYTES", 8 * 3 * bits)  # a word at a time
    rng = random.Random(bits)
    y = [[rng.randrange(2**bits) for _ in range(3)] for _ in range(rows)]
    seen = whitening.Scatter(3, bits)
    seen.add(np.array(y, dtype=np.uint64))
    got = defaultdict(int)
    for i, j, limb, value in seen.limbs():
        got[i, j] += value << (whitening.LIMB * limb)
    for i in range(3):
        assert got[-1, i] == sum(r[i] for r in y)
        for j in range(i, 3):
            assert got[i, j] == sum(r[i] * r[j] for r in y)


def test_whitening_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    held_to_plain(queries.QUERIES["op11_embedding_whitening"](spark, folder).collect(), rows)


# --- prefix trie ---

TURN_FIELDS = "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in ["at", "depth", "seq", *CLASHING])


def plain_trie(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    convs = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c, turns in convs.items():
        h, base = crc32(str(c).encode()) % 6, c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        built[c] = tuple(convs.get(base, [])[:h] + turns[h:])
    nodes, kids = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    for s in nodes:
        if s:
            kids[s[:-1]].append(s)
    below, out = {}, []
    for s in sorted(nodes, key=len, reverse=True):
        parts = [below[k] for k in kids[s]]
        saved = (len(nodes[s]) - 1) * (len(s[-1][1]) if s else 0) + sum(p[1] for p in parts)
        below[s] = (sum(p[0] for p in parts) if parts else 1, saved)
        ends = sorted(c for c in nodes[s] if len(built[c]) == len(s))
        parent = min(nodes[s[:-1]]) if s else None
        out.append((min(nodes[s]), len(s), parent, len(nodes[s]), len(kids[s]), *below[s], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def told(rows):
    return sorted(map(repr, map(tuple, rows)))


def turn_table(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * (len(CLASHING) + 3)) for r in rows], TURN_FIELDS)


def test_trie_of_odd_rows(spark):
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 40), 100, 101, 150, 205, 206, 399, -7, -100, -3, 10**15, 10**15 + 1]:
        for t in range(rng.choice([1, 2, 3, 5, 6, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é🙂", "", None, "a long text " * 50])))
    rows += [(1, 0, "user", "tie"), (1, 0, "user", "tie"), (1, None, "user", "first"), (1, None, None, None), (None, 1, "user", "no conversation"), (2, 10**12, "user", "x" * 30_000)]
    rows += [(300, 0, "user", "only here")]  # its base is itself
    rows += [(c, t, "user", "copy") for c in range(500, 560) for t in range(7)]  # copies
    assert told(prefix_trie.prefix_trie(turn_table(spark, rows).repartition(4)).collect()) == told(plain_trie(rows))
    assert prefix_trie.prefix_trie(turn_table(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(turn_table(spark, rows).where("conv_id IS NULL")).count() == 0


def test_trie_of_conversation_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_A_STRING", 7)
    rng = random.Random(9)
    rows = [(1, t, "user", f"turn {t % 5}") for t in range(900)] + [(2, t, "user", f"turn {t % 5}") for t in range(850)]
    rows += [(c, t, "user", "same") for c in range(1000, 1100) for t in range(rng.choice([2, 6]))]
    folded = prefix_trie.own_prefixes(prefix_trie.turn_rows(turn_table(spark, rows), "conv_id", "turn", "role", "text").repartition(3))
    for c, n in ((1, 900), (2, 850)):
        got = sorted((r["at"], r["hash"], r["chars"]) for r in folded.where(F.col("conv_id") == c).collect())
        hash_, chars = 0, 0
        for t in range(n):
            digest = hashlib.md5(f"4:userturn {t % 5}".encode()).digest()
            hash_, chars = (hash_ * prefix_trie.FACTOR + int.from_bytes(digest, "big")) % prefix_trie.PRIME, chars + 6
            assert got[t] == (t + 1, bytearray(hash_.to_bytes(16, "big")), chars)
    sys.setrecursionlimit(5000)
    assert told(prefix_trie.prefix_trie(turn_table(spark, rows)).collect()) == told(plain_trie(rows))


def test_hashes_compose():
    rng = random.Random(1)
    fold = lambda xs: __import__("functools").reduce(lambda a, x: (a * prefix_trie.FACTOR + x) % prefix_trie.PRIME, xs, 0)
    for n, m in ((0, 0), (3, 4), (0, 9), (5, 5000)):
        a, b = ([rng.randrange(2**128) for _ in range(k)] for k in (n, m))
        assert prefix_trie.joined(fold(a), fold(b), m) == fold(a + b)


# --- quality rules ---


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(again)


def test_counts(odd, nothing):
    texts = [t or "" for _, t in [(r["doc_id"], r["text"]) for r in odd.collect()]]
    texts += ["a b c a b c", "a b a b a b a", "x\x1cy z\x85w v", "one\n one\none\n\n\none \none", "\x0b\x0c\r", "|<>#*$%& ok", "a a a a", "🙂 " * 5]
    for text in texts:
        assert quality_rules.text_counts(text)[:5] == plain_counts(text)
    got = quality_rules.judged(odd, []).collect()
    want = [(r["doc_id"], *plain_counts(r["text"] or "")) for r in odd.collect()]
    assert told([(r["doc_id"], *(r[c] for c in quality_rules.COUNTS[:5])) for r in got]) == told(want)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    assert quality_rules.judged(nothing, []).count() == 0


def test_learned_list_is_its_sql(spark):
    rng = np.random.default_rng(5)
    n = 1500
    counts = {c: rng.integers(0, 60, n) for c in quality_rules.COUNTS}
    counts["n_words"] = rng.integers(0, 300, n)
    table = spark.createDataFrame([(i, *(int(counts[c][i]) for c in quality_rules.COUNTS)) for i in range(n)], "i long, " + ", ".join(f"{c} long" for c in quality_rules.COUNTS))
    rows = table.select("i", *(F.expr(quality_rules.ratio_sql(r)).alias(r) for r in quality_rules.RATIOS)).orderBy("i").collect()
    values = {r: np.array([row[r] for row in rows]) for r in quality_rules.RATIOS}
    bad = (values["symbols_a_word"] > 0.5) & (values["words"] > 60) | (values["repeated_lines"] > 2) & (values["words"] <= 150)
    rules = quality_rules.learned(values, bad, np.arange(n) % 3 == 2)
    assert rules and all(1 <= len(r.conditions) <= quality_rules.MOST_CONDITIONS for r in rules)
    first = np.zeros(n, dtype=int)
    for at, rule in enumerate(rules, 1):
        first[(first == 0) & rule.holds(values)] = at
    got = [r["rule"] or 0 for r in table.withColumn("rule", quality_rules.first_rule(rules)).orderBy("i").collect()]
    assert got == first.tolist()
    assert ((first > 0) == bad).mean() > 0.95
    noisy = quality_rules.learned(values, rng.random(n) < 0.3, np.arange(n) % 3 == 2)
    assert not noisy  # labels that follow no count give no rule


def test_rules_without_labels(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.fit_rules(odd, labels) == [] and quality_rules.fit_rules(nothing, labels) == []
    odd_labels = spark.createDataFrame([(i, q, None) for i, q in ((4, 0), (4, 1), (5, None), (None, 0), (6, 1), (15, 1), (99, 0))], "doc_id long, quality int, toxic int")
    assert quality_rules.fit_rules(odd, odd_labels) == []


def test_rules_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    found = queries.QUERIES["op13_quality_rules"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("crc32(cast(doc_id as string)) % 3 = 1")
    rows = found.join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) > 0.98 * len(rows) > 500
