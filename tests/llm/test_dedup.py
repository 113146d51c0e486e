import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash

from ledgerline.llm import components, exact_dedup, simhash

from .fixtures import documents, empty, plain, rows


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """(id, fingerprint) rows to the component of each, by comparing all."""
    n, root = len(pairs), list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(pairs[i][1] ^ pairs[j][1]).count("1") <= 4:
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (id_, _) in enumerate(pairs):
        r = find(i)
        if id_ is not None and (least[r] is None or id_ < least[r]):
            least[r] = id_
    return [(id_, format(fp, "016x"), least[find(i)]) for i, (id_, fp) in enumerate(pairs)]


def test_near_duplicates_equal_brute_force(spark):
    want = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows()])
    got = [tuple(r) for r in simhash.near_duplicates(spark, documents(spark)).collect()]
    assert Counter(got) == Counter(want)
    assert len({c for i, _, c in want if i is not None and 130 <= i < 135}) == 1


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(spark, empty(spark)).count() == 0


def test_embedding_bounds_hamming_distance():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 5000, dtype=np.uint64), rng.integers(0, 2**63, 5000, dtype=np.uint64)
    seg = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * i)) & np.uint64(3)) for i in range(32)]).astype(int)
    want = np.abs(seg(a) - seg(b)).sum(0)
    assert (simhash.manhattan(simhash.embed(a), simhash.embed(b)) == want).all()
    assert (want <= np.bitwise_count(a ^ b)).all()


def near_points(n, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    flips = np.zeros(n, np.uint64)
    for _ in range(4):
        flips ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    hub = np.uint64(12345)
    near_hub = np.array([hub ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i in range(64) for j in range(i)], np.uint64)
    return np.unique(np.concatenate([base, base ^ flips, near_hub]))


def test_grid_finds_every_link(spark):
    fps = near_points(400)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components.connected_components(spark, simhash.near_links(spark, df)).collect()}
    got = defaultdict(set)
    for x in fps.view(np.int64).tolist():
        got[roots.get(x, x)].add(x)
    d = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    label = np.arange(len(fps))
    while True:
        new = np.where(d, label[None], len(fps)).min(1)
        if (new == label).all():
            break
        label = new
    want = defaultdict(set)
    for x, k in zip(fps.view(np.int64).tolist(), label.tolist(), strict=True):
        want[k].add(x)
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values()}


def test_hot_cells_are_split_into_slabs(spark, monkeypatch):
    fps = near_points(20)
    cells = np.zeros(len(fps), np.int64)
    monkeypatch.setattr(simhash, "SLAB", 500)
    batches = [simhash.pa.RecordBatch.from_arrays([simhash.pa.array(cells[i : i + 300]), simhash.pa.array(fps[i : i + 300].view(np.int64))], names=["cell", "fp"]) for i in range(0, len(fps), 300)]
    out = [r for b in simhash._within(batches) for r in b.to_pylist()]
    assert all(r["cell"] == 0 for r in out) and sorted(r["u"] for r in out) == sorted(fps.view(np.int64).tolist())
    assert max(Counter(r["slab"] for r in out).values()) == 500
    handed = spark.createDataFrame([(r["cell"], r["u"], r["slab"]) for r in out], "cell long, u long, slab long")
    edges = simhash.hot_cell_links(spark, handed)
    roots = {r.node: r.root for r in components.connected_components(spark, edges).collect()}
    hub = [x for x in fps.tolist() if bin(x ^ 12345).count("1") <= 2]
    signed = [int(np.uint64(x).view(np.int64)) for x in hub]
    assert len({roots.get(x, x) for x in signed}) == 1


def components_of(nodes, edges):
    root = {int(x): int(x) for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        root[find(int(u))] = find(int(v))
    held = defaultdict(set)
    for x in root:
        held[find(x)].add(x)
    return {frozenset(v) for v in held.values()}


def test_slab_pairs_keep_chains_whole():
    """Chains in 3-bit steps dealt over two slabs: only links from slab to slab join them, and all must be joined."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        points = []
        for _ in range(6):
            bits = rng.permutation(64)[:60].reshape(20, 3)
            steps = np.array([sum(1 << int(b) for b in row) for row in bits], np.uint64)
            points.append(np.bitwise_xor.accumulate(np.r_[rng.integers(0, 2**63, 1, dtype=np.uint64), steps]))
        side = np.concatenate([np.arange(len(c)) % 2 for c in points])
        fps = np.concatenate(points)
        order = rng.permutation(len(fps))
        fps, side = fps[order], side[order]
        a, b = fps[side == 0], fps[side == 1]
        hit = np.argwhere(np.bitwise_count(a[:, None] ^ b[None]) <= 4)
        want = components_of(fps, [(a[i], b[j]) for i, j in hit])
        edges = [(u, v) for us, vs in simhash.spanning(a, b) for u, v in zip(us, vs, strict=True)]
        assert components_of(fps, edges) == want and len(edges) == len(fps) - len(want)


def test_connected_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(1, 2), (2, 1), (7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(101, 161)} == {100} and {got[i] for i in range(501, 700)} == {500} and got[2] == 1 and 7 not in got


def test_drop_near_duplicates_keeps_one_of_each(spark):
    docs = documents(spark)
    kept = simhash.drop_near_duplicates(spark, docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    want = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows()])
    assert {i for i in ids if i is not None} == {c for _, _, c in want if c is not None}
    assert Counter(i for i in ids if i not in (None, 160)).most_common(1)[0][1] == 1 and ids.count(160) == 2  # two texts share that id


def brute_exact(data):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in data]
    groups = defaultdict(list)
    for i, t in enumerate(norm):
        groups[t].append(i)
    out = []
    for t, members in groups.items():
        ids = [data[i][0] for i in members if data[i][0] is not None]
        for i in members:
            out.append((data[i][0], min(ids, default=None), len(members), hashlib.sha256(t.encode()).hexdigest()))
    return out, {t: min([data[i][0] for i in m if data[i][0] is not None], default=None) for t, m in groups.items()}


def test_exact_duplicates_equal_brute_force(spark):
    for fan_in in (2, 8):
        got = exact_dedup.exact_duplicates(spark, documents(spark), fan_in=fan_in).collect()
        want, kept = brute_exact(rows())
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(want)
        assert sum(r.kept for r in got) == len(kept) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_runs_are_merged_in_blocks(monkeypatch):
    """Sorted runs of many small blocks, equal digests across runs and blocks, null identifiers: against a dictionary."""
    monkeypatch.setattr(exact_dedup, "BLOCK", 7)
    rng = np.random.default_rng(5)
    runs, want = [], defaultdict(list)
    for run in range(6):
        digests = sorted(hashlib.sha256(bytes([x])).digest() for x in rng.integers(0, 90, 120).tolist())
        ids = [None if x == 0 else int(x) for x in rng.integers(0, 50, len(digests))]
        for i, (h, doc_id) in enumerate(zip(digests, ids, strict=True)):
            want[h].append((doc_id is None, doc_id or 0, run * 1000 + i))
        runs.append((digests, ids, [run * 1000 + i for i in range(len(digests))]))
    arrays = lambda d, i, r: [pa.array(d, pa.binary()), pa.array([3] * len(d), pa.int64()), pa.array([5] * len(d), pa.int64()), pa.array(i, pa.int64()), pa.array(r, pa.int64())]
    names = ["digest", "size_bytes", "check", "doc_id", "_row"]
    batches = lambda run: [pa.RecordBatch.from_arrays(arrays(*(c[k : k + 11] for c in run)), names=names) for k in range(0, len(run[0]), 11)]
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": staticmethod(lambda: 0)}))
    sent = [b for run in runs for b in exact_dedup.first_runs(batches(run), 1, 1)]
    assert max(len(x) for b in sent for x in b.column(2).to_pylist()) <= 7 * exact_dedup.RECORD.itemsize
    rows = sorted((r for b in sent for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:2])
    sorted_ = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 3], strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["node", "first", "block"]) for k in range(0, len(rows), 3)]
    got = [r for b in exact_dedup.opened(sorted_) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    least = {h: min(x) for h, x in want.items()}
    assert got == [(h, 3, 5, None if least[h][0] else least[h][1], least[h][2], len(want[h])) for h in sorted(want)]


def test_exact_duplicates_of_nothing(spark):
    assert exact_dedup.exact_duplicates(spark, empty(spark)).count() == 0
    assert exact_dedup.drop_exact_duplicates(spark, empty(spark)).columns == empty(spark).columns


def test_drop_exact_duplicates_keeps_rows_whole(spark):
    docs = documents(spark)
    kept = exact_dedup.drop_exact_duplicates(spark, docs)
    assert kept.columns == docs.columns
    _, want = brute_exact(rows())
    assert Counter(r.doc_id for r in kept.collect()) == Counter(want.values())
    assert exact_dedup.drop_exact_duplicates(spark, plain(spark)).count() == len(want)
