"""Near-duplicates, suffixes, decontamination, toxicity and the pipeline against plain versions."""

import hashlib
import re
import tracemalloc
from collections import Counter, defaultdict
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
import xxhash
from odd_tables import CLASHING, FIELDS, prose

import corpus_pipeline
from sigspark.llm import components, decontam, near_copies, queries, simhash, suffixes, toxicity


def ids_and_texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def told(rows):
    return sorted(map(repr, rows))


# --- components and near-duplicates ---


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_component_rounds_broadcast_nothing(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(20)], "a long, b long")
    found = components.star(components.star(links, smaller=False), smaller=True)
    assert len(found.collect()) == 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_fit_holds_no_string_for_each_occurrence(monkeypatch):
    class Built(Exception):
        pass

    def stop(*_, **__):
        raise Built

    texts = [". ".join(" ".join(f"w{(i * 7 + j * j) % 211:03d}" for j in range(100)) for _ in range(20)) for i in range(150)]
    monkeypatch.setattr(toxicity, "fit_linear", stop)
    tracemalloc.start()
    try:
        with pytest.raises(Built):
            toxicity.fit(texts, np.arange(150) % 2, 0.5, landmarks=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 * 200_000  # 200,000 occurrences of 211 words; a string takes 55 bytes

def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(odd, nothing):
    got = simhash.simhash_groups(odd).collect()
    prints = {t: plain_fingerprint(t) for _, t in ids_and_texts(odd)}
    links = [(a, b) for a, b in combinations(sorted(set(prints.values())), 2) if (a ^ b).bit_count() <= 3]
    root = roots(set(prints.values()), links)
    least = defaultdict(list)
    for i, t in ids_and_texts(odd):
        least[root[prints[t]]].append(i)
    name = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    want = [(i, np.uint64(prints[t]).view(np.int64).item(), name[root[prints[t]]]) for i, t in ids_and_texts(odd)]
    assert told((r["doc_id"], r["fp"], r["component_id"]) for r in got) == told(want)
    assert simhash.simhash_groups(nothing).count() == 0
    kept = ids_and_texts(simhash.drop_near_duplicates(odd))
    assert Counter(root[prints[t]] for _, t in kept) == {k: 1 for k in least}
    assert all(i == name[root[prints[t]]] for i, t in kept)
    assert simhash.drop_near_duplicates(odd).columns == odd.columns


@pytest.mark.parametrize("dense", [2, 48])
def test_links_of_fingerprints(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(4)
    fps = set(rng.integers(0, 2**63, 60, dtype=np.uint64).tolist())
    for centre in list(fps)[:12]:
        for _ in range(40):
            flips = rng.choice(64, rng.integers(1, 5), replace=False)
            fps.add(centre ^ sum(1 << int(b) for b in flips))
    signed = lambda x: np.uint64(x).view(np.int64).item()
    links = [(signed(a), signed(b)) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 3]
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.fingerprint_components(nodes).collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == {n: r for n, r in want.items() if n != r}


def test_covering():
    rng = np.random.default_rng(5)
    half = rng.integers(0, 2**31, 2000).astype(np.uint32)
    rows, words = simhash.anchors(half)
    assert not simhash.syndrome(words).any() and (np.bitwise_count(half[rows] ^ words) <= 2).all()
    at = defaultdict(set)
    for r, w in zip(rows.tolist(), words.tolist()):
        at[r].add(w)
    one_off = half ^ (np.uint32(1) << rng.integers(0, 31, 2000).astype(np.uint32))
    rows2, words2 = simhash.anchors(one_off)
    for r, w in zip(rows2.tolist(), words2.tolist()):
        at[r + 10_000].add(w)
    assert all(at[i] & at[i + 10_000] for i in range(2000))


# --- near copies ---


def plain_groups(texts, width=5, similarity=0.8):
    """Of each text the least text that links lead to, and the links."""
    sets = {}
    for t in texts:
        words = t.encode().lower().split()
        sets[t] = frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()
    alike = lambda x, y: x == y or len(x & y) / len(x | y) >= similarity
    links = [(a, b) for a, b in combinations(sets, 2) if alike(sets[a], sets[b])]
    return roots(sets, links), links


def edited(seed, n, every, at):
    words = prose(seed, n).split()
    words[at::every] = [f"new{at}" for _ in words[at::every]]
    return " ".join(words)


def near_rows(odd):
    rows = ids_and_texts(odd) + [(1000 + 10 * s + at, edited(s, 300, 70 + 5 * s, at)) for s in range(12) for at in (0, 20, 40)]
    return rows + [(2000 + k, " ".join(["same words of a long template"] * 3) + " " + prose(70, 120) + f" end{k} of{k} it") for k in range(40)]


@pytest.mark.parametrize("stars", [0, 2])
def test_near_copy_groups(spark, odd, nothing, stars):
    rows = near_rows(odd)
    root, links = plain_groups([t for _, t in rows])
    fps = [(simhash.majority(simhash.shingle_hashes(a)) ^ simhash.majority(simhash.shingle_hashes(b))).bit_count() for a, b in links]
    assert max(fps) > 3  # links that op6's rule does not make
    got = near_copies.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), stars=stars).collect()
    key = lambda i, t: hashlib.md5(f"{'null' if i is None else i}\n{t}".encode()).digest()
    want = {key(i, t): root[t] for i, t in rows}
    named = {(bytes(r["root"]), want[bytes(r["key"])]) for r in got}
    assert len(got) == len(rows) and len(named) == len({a for a, _ in named}) == len({b for _, b in named})
    assert near_copies.near_copy_groups(nothing).count() == 0


def test_near_copies_are_searched_by_fingerprint(spark, monkeypatch):
    """Without the exact search that follows, SimHash's anchors still bring together whatever is within three bits, and links are checked."""
    base = prose(3, 400).split()
    rows = [(k, " ".join([*base[:200], f"w{k}", *base[200:]])) for k in range(6)] + [(10 + k, prose(50 + k, 300)) for k in range(6)] + [(20, " ".join(base) + " " + " ".join(base))]
    texts = [t for _, t in rows]
    fp = [simhash.majority(simhash.shingle_hashes(t, near_copies.WIDTH)) for t in texts]
    sets = [set(near_copies.shingle_set(t).tolist()) for t in texts]
    near = {(a, b) for a, b in combinations(range(len(rows)), 2) if (fp[a] ^ fp[b]).bit_count() <= 3 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(near) >= 5
    nothing_more = lambda shared, linked, *rest: spark.createDataFrame([], "a binary, b binary")
    monkeypatch.setattr(near_copies, "pairs_with_pivots", nothing_more)
    monkeypatch.setattr(near_copies, "pairs_by_prefix", nothing_more)
    root = {r["doc_id"]: bytes(r["root"]) for r in near_copies.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(root[rows[a][0]] == root[rows[b][0]] for a, b in near)
    assert len({root[10 + k] for k in range(6)}) == 6


def test_prefixes_lose_no_pair(spark):
    """Sets that meet in one band: all pairs of 0.8 are found, and sets that only share what all have are no candidates."""
    rng = np.random.default_rng(5)
    sets, template = {}, rng.integers(0, 2**62, 100)
    for k in range(120):  # under 0.8 to each other
        sets[f"t{k:03}"] = {*template[:70].tolist(), *rng.integers(0, 2**62, 30).tolist()}
    for n in (1, 2, 4, 5, 9, 10, 35, 45, 90):  # copies with exactly 0.8, just under it, and more
        own = rng.integers(0, 2**62, n + 40).tolist()
        sets[f"c{n:02}"] = set(own[:n])
        for k, (less, more) in enumerate([(n // 5, 0), (n // 5 + 1, 0), (0, n // 4), (0, n // 4 + 1), (n // 9, n // 9)]):
            sets[f"c{n:02}{k}"] = set(own[less : n + more])
    jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and jaccard(sets[a], sets[b]) >= 0.8}
    rows = [(bytearray(k.encode()), sorted(v)) for k, v in sets.items() if v]
    table = spark.createDataFrame(rows, "node binary, hashes array<long>")
    shared = table.selectExpr("1L AS band", "node", "size(hashes) AS n")
    got = {(bytes(r["a"]).decode(), bytes(r["b"]).decode()) for r in near_copies.pairs_by_prefix(shared, None, table, 0.8).collect()}
    assert want <= got and len(want) > 40 and not any(a[0] == b[0] == "t" for a, b in got)
    linked = table.selectExpr("node", "CAST('c01' AS BINARY) AS root")
    assert near_copies.pairs_by_prefix(shared, linked, table, 0.8).count() == 0


def test_near_duplicates_stage(spark, odd):
    rows = near_rows(odd)
    root, _ = plain_groups([t for _, t in rows])
    least = {}
    for i, t in rows:
        least[root[t]] = min(least.get(root[t], (True, 0)), (i is None, i or 0))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert told((root[t], (i is None, i or 0)) for i, t in ids_and_texts(kept)) == told(least.items())


# --- suffixes ---


def plain_cut(texts, length):
    datas = [t.encode() for t in texts]
    times = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"crowd": 1}, {"piece": 500}, {"length": 60, "gram": 9}, {"length": 60, "gram": 60}])
def test_suffix_dedup(odd, options):
    rows = ids_and_texts(odd)
    want = [(i, *cut) for (i, _), cut in zip(rows, plain_cut([t for _, t in rows], options.get("length", 400)))]
    got = suffixes.suffix_dedup(odd, **options)
    assert told((r["row"]["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got.collect()) == told(want)


def test_many_windows_in_slices(monkeypatch):
    monkeypatch.setattr(suffixes, "AT_ONCE", 50)
    rng = np.random.default_rng(2)
    content = [bytes(rng.integers(97, 99, 40).astype(np.uint8)) for _ in range(40)]
    group = np.repeat(np.arange(4), 10)
    distance = rng.integers(0, 30, 40)
    monkeypatch.setattr(suffixes, "TOKEN", 4)
    row, window = suffixes.repeated_windows(group, content, distance, np.zeros(40, bool), length=12)
    seen = defaultdict(list)
    for r in range(40):
        for w in range(len(content[r]) - 11):
            seen[group[r], distance[r] - w, content[r][w : w + 12]].append((r, w))
    want = sorted(x for v in seen.values() if len(v) > 1 for x in v)
    near = lambda r, w: 0 <= distance[r] - w  # noqa: E731  windows hold their anchor
    assert sorted((r, w) for r, w in zip(row.tolist(), window.tolist()) if near(r, w)) == [x for x in want if near(*x)]


def test_without_repeats(odd, nothing):
    kept = suffixes.without_repeats(odd, n_chars="n_chars")
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert all((r["text"] is None) or r["n_chars"] == len(r["text"]) for r in kept.collect())
    assert suffixes.suffix_dedup(nothing).count() == 0


def plain_word_cut(texts, n, length=400):
    """Kept bytes without repeated runs of n words and repeated strings of ``length`` bytes."""
    datas = [t.encode() for t in texts]
    words = [list(re.finditer(rb"[^\x20\x09-\x0D]+", d)) for d in datas]
    times = Counter(tuple(m.group() for m in w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    strings = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    for d, w in zip(datas, words):
        gone = bytearray(len(d))
        for i in range(len(w) - n + 1):
            if times[tuple(m.group() for m in w[i : i + n])] > 1:
                a, b = w[i].start(), w[i + n - 1].end()
                gone[a:b] = b"\1" * (b - a)
        for i in range(len(d) - length + 1):
            if strings[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield bytes(x for x, g in zip(d, gone) if not g)


@pytest.mark.parametrize("words", [3, 51])
def test_runs_of_words(odd, words):
    rows = ids_and_texts(odd)
    want = [(i, hashlib.sha256(kept).hexdigest()) for (i, _), kept in zip(rows, plain_word_cut([t for _, t in rows], words))]
    got = suffixes.suffix_dedup(odd, words=words)
    assert told((r["row"]["doc_id"], r["kept_sha256"]) for r in got.collect()) == told(want)


def test_passage_stage(spark):
    short = lambda seed, n: " ".join(w[:4] for w in prose(seed, n).split())
    passage, less = short(20, 51), short(21, 50)
    assert len(passage.encode()) < 320
    rows = [(1, f"{prose(22, 30)} {passage}. {prose(23, 9)}"), (2, f"{prose(24, 70)}\n{passage} é {less}"), (3, f"{less} {prose(25, 40)}")]
    rows = [(i, t.replace(passage + ".", passage + " ."), len(t)) for i, t in rows]
    got = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), "")
    assert dict(ids_and_texts(got)) == {i: t.replace(passage, "") for i, t, _ in rows}


# --- decontamination ---


def plain_shingles(text):
    words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def test_decontamination(spark, odd, nothing):
    item = prose(50, 40)
    near = item.split()
    near[0] = "other"
    far = item.split()
    far[10], far[20], far[30] = "some", "other", "words"
    repeats = "the cat sat on the mat and the cat sat on the mat and the cat sat on the hat"
    extra = [(100, prose(51, 50) + ", " + item.upper() + ". " + prose(52, 50)), (101, " ".join(near)), (102, " ".join(far)), (103, repeats + " x"), (103, repeats + " x"), (104, item + " " + item), (105, "one two")]
    docs = odd.unionByName(spark.createDataFrame([(i, t, None, None, None, *["c"] * len(CLASHING)) for i, t in extra], FIELDS))
    items = [(1, item), (2, repeats), (3, None), (4, ""), (5, "one two"), (6, prose(2, 60)), (7, prose(2, 60)), (None, prose(99, 90))]
    bench = spark.createDataFrame([(*x, "clash", "clash") for x in items], "item_id long, text string, m string, item string")
    want = set()
    for doc_id, text in ids_and_texts(docs):
        x = plain_shingles(text)
        for item_id, words in items:
            y = Counter(plain_shingles(words or ""))
            m = sum(y.values())
            best = 0
            for p in range(len(x) if m else 0):
                window = Counter(x[p : p + m])
                shared = sum(min(v, y[s]) for s, v in window.items())
                best = max(best, shared / (sum(window.values()) + m - shared))
            if best >= 0.8:
                want.add((doc_id, item_id, round(best, 9)))
    got = decontam.matches(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got} == want
    assert {(100, 1), (101, 1), (103, 2), (105, 5)} <= {(a, b) for a, b, _ in want} and (102, 1) not in {(a, b) for a, b, _ in want}
    bad = {i for i, _, _ in want}
    assert told(r[0] for r in ids_and_texts(decontam.drop_contaminated(docs, bench)) if r[0] is not None) == told(i for i, _ in ids_and_texts(docs) if i is not None and i not in bad)
    assert told(ids_and_texts(decontam.drop_contaminated(docs, bench, most_sent=1))) == told(ids_and_texts(decontam.drop_contaminated(docs, bench)))
    blocked = decontam.anchors(decontam.documents(docs).withColumn("key", decontam.row_key()), decontam.item_table(bench, "item_id", "text"), block=7)
    whole = decontam.anchors(decontam.documents(docs).withColumn("key", decontam.row_key()), decontam.item_table(bench, "item_id", "text"))
    assert blocked.count() == whole.count() > 0
    assert decontam.matches(nothing, bench).count() == 0 and decontam.matches(docs, bench.where("item_id = 4")).count() == 0


def test_blocks_cover_the_radius():
    cuts = [64 * b // (decontam.RADIUS + 1) for b in range(decontam.RADIUS + 2)]
    assert cuts[0] == 0 and cuts[-1] == 64 and len(set(cuts)) == decontam.RADIUS + 2


# --- toxicity ---

INSULTS = ["vilewort", "grubnard", "skunkel"]


def labelled(n):
    rng = np.random.default_rng(8)
    for i in range(n):
        sentences = [prose(1000 + 7 * i + k, int(rng.integers(5, 12))) for k in range(4)]
        toxic = i % 3 == 0
        if toxic:
            for k in (1, 2):
                sentences[k] += " you " + INSULTS[int(rng.integers(0, 3))] + " go"
        yield i, ". ".join(sentences) + ".", int(toxic)


def plain_kernel(s, t):
    total = 0.0
    for a in combinations(range(len(s)), 3):
        for b in combinations(range(len(t)), 3):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel():
    words = ["idiot", "idiiot", "id-iot", "other", "banana", "ana"]
    kernel = toxicity.Kernel(["idiot", "banana", "ban"])
    for many in (1, 1000):
        toxicity.MANY, before = many, toxicity.MANY
        got = kernel.against(words)
        toxicity.MANY = before
        for i, w in enumerate(words):
            for j, x in enumerate(kernel.landmarks):
                want = plain_kernel(w, x) / np.sqrt(plain_kernel(w, w) * plain_kernel(x, x))
                assert got[i, j] == pytest.approx(want**toxicity.POWER, abs=1e-5)


def test_toxicity(spark, odd, nothing):
    rows = list(labelled(240))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    known = [(i, y, "clash", "clash") for i, _, y in rows] + [(None, 1, "", ""), (5, None, "", "")]
    labels = spark.createDataFrame(known, "doc_id long, toxic int, label string, score string")
    model = toxicity.fit_on(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, model).collect()}
    held = [(scores[i], y) for i, _, y in rows if crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.95
    gapped = model.scores(["Some. You v i l e w o r t go. You grub-nard go.", "Some. You go now. We go then."], {})
    assert gapped[0] > gapped[1]
    once, one_by_one = model.scores([t for _, t, _ in rows[:20]], {}), [model.scores([t], {})[0] for _, t, _ in rows[:20]]
    assert np.allclose(once, one_by_one)
    out = toxicity.toxicity_scores(odd, model).collect()
    assert told(r["doc_id"] for r in out) == told(i for i, _ in ids_and_texts(odd)) and all(0 <= r["score"] <= 1 for r in out)
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert "ArrowEvalPython" in kept._jdf.queryExecution().toString() and "MapInArrow" not in kept._jdf.queryExecution().toString()  # rows stay where they are
    assert toxicity.toxicity_scores(nothing, model).count() == 0
    one_kind = toxicity.fit_on(docs, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.toxicity_scores(docs, one_kind).collect()} == {0.0}
    assert toxicity.fit_on(docs, labels.limit(0)).prior == 0.0


# --- queries and pipeline ---

FOLDER = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = [docs.count()]
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, corpus_pipeline.persist_table(stage(spark, docs, FOLDER), "stage")
        sizes.append(docs.count())
        assert at == len(corpus_pipeline.STAGES) - 1 or docs.columns == before.columns
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] >= sizes[4] == sizes[5] > 0
    assert corpus_pipeline.run(spark, FOLDER).count() == sizes[-1]


def test_names():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14)) and set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, FOLDER), connection.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert told(tuple(map(str, r)) for r in got.select(columns).collect()) == told(tuple(map(str, r)) for r in want.fetchall())


def test_rest_has_no_use_of_it():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    users = [p for p in (root / "sigspark").rglob("*.py") if "llm" not in p.parts and "sigspark.llm" in p.read_text()]
    assert not users


def test_one_worker_a_task_searches_runs_of_words(odd, monkeypatch):
    plans = {}

    def persist(df, name, write=suffixes.persist_table):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(suffixes, "persist_table", persist)
    suffixes.suffix_dedup(odd, words=51).count()
    assert len(plans["grams"]) == 2 and all(p.count("MapInArrow") == 1 for name in ("grams", "suffixes") for p in plans[name])


def test_large_group_of_surroundings_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    content = [rng.integers(97, 123, 700, dtype=np.uint8).tobytes() for _ in range(4000)]
    group, distance = np.zeros(4000, int), np.full(4000, 300)
    tracemalloc.start()
    row, window = suffixes.repeated_windows(group, [*content[:-1], content[0]], distance, np.zeros(4000, bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(row.tolist()) == {0, 3999} and sorted(window[row == 0].tolist()) == list(range(301))
    assert peak < 50e6


def test_hashes_of_rows_are_those_of_their_bytes(monkeypatch):
    monkeypatch.setattr(suffixes, "HASHED", 50)
    rng = np.random.default_rng(4)
    content = [rng.integers(0, 256, n, dtype=np.uint8) for n in (30, 1, 90, 20, 7, 64)]
    hashes = suffixes.RowHashes(np.concatenate(content), np.array([len(c) for c in content]), suffixes.BASES[1])
    for r, data in enumerate(content):
        start = np.arange(len(data))
        alone = suffixes.Hashes(data, suffixes.BASES[1])
        assert (hashes.of(np.full(len(data), r), start, np.full(len(data), len(data))) == alone.of(start, np.full(len(data), len(data)))).all()


def test_word_values_take_bounded_memory_and_stay_right():
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(200)) for _ in range(120)]
    labels = np.arange(120) % 2
    model = toxicity.fit([f"{t} grubnard vilewort" if y else t for t, y in zip(texts, labels)], labels, 0.5)
    cache = {}
    first = model.scores(texts, cache)
    assert len(cache["words"].hashes) == toxicity.SLOTS and cache["words"].hashes.nbytes + cache["words"].values.nbytes <= 16 << 20
    assert np.allclose(model.scores(texts, cache), first) and np.allclose(model.scores(texts, {"words": toxicity.KnownWords(64)}), first)


def test_known_words_with_few_places():
    known = toxicity.KnownWords(8)
    words = [f"w{i}" for i in range(100)]
    known.keep(words, np.arange(100.0))
    values, found = known.look_up(words)
    assert 0 < found.sum() <= 8 and (values[found] == np.flatnonzero(found)).all()
    known.keep(words, np.full(100, -1.0))
    assert (known.look_up(words)[0][found] == values[found]).all() and not known.look_up([])[1].size


def test_token_edges_as_by_the_pattern():
    for token in ["a_b", "_x_", "__", "word,", "(word)", "«word»", "-–word…!", "ab", "é!é", "!?", "x" * 40 + ".", "`~", "don't", "́abc", "²ab²"]:
        word = toxicity.EDGES.sub("", token)
        assert "".join(toxicity.pieces(token))[1:4] == word[:3] if len(word) >= 3 else toxicity.pieces(token) == []
