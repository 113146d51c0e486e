import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from ledgerline.llm import mixing, packing
from ledgerline.llm.tokenizing import WordTokenizer

from .fixtures import DOC, documents, empty, plain, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_targets(sizes):
    """Sources in order (None last) with sizes to targets: share by weight, cap, share the excess, again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(out.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level >= 3 * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in open_}
        out |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return out


def test_mix_meets_its_targets(spark):
    docs = documents(spark)
    got = mixing.mix(spark, docs).collect()
    sizes = defaultdict(int)
    for r in rows():
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = brute_targets(dict(sizes))
    assert len(got) == len(rows())
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source_size, round(r.target, 6)][0] += r.taken
    for s, n in sizes.items():
        taken = by[n, round(want[s], 6)][0]
        assert abs(taken - want[s]) <= 3, (s, n, want[s], taken)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    again = mixing.mix(spark, docs.repartition(2)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_epochs_precede_the_fraction_and_order_follows_keys(spark):
    docs = spark.createDataFrame([(i, "a " * (i % 5 + 1), "en", "big" if i % 10 else "small", 1) for i in range(300)], DOC)
    got = mixing.mix(spark, docs).collect()
    keyed = docs.select("doc_id", "source", mixing.key(docs.doc_id, mixing.quality(docs.text), 7).alias("k")).collect()
    key, source = {r.doc_id: r.k for r in keyed}, {r.doc_id: r.source for r in keyed}
    for s in ("big", "small"):
        mine = sorted((key[r.doc_id], r.taken - math.floor(r.target / r.source_size) * r.size, r.size) for r in got if source[r.doc_id] == s)
        extra = [e / n for _, e, n in mine]
        assert all(0 <= e <= 1 for e in extra) and extra == sorted(extra, reverse=True)


def test_mixed_documents_repeat_rows(spark):
    docs = documents(spark)
    mixed = mixing.mixed_documents(spark, docs)
    assert mixed.columns == docs.columns
    times = Counter((r.doc_id, r.text, r.source) for r in mixed.collect())
    rowcount = Counter((r.doc_id, r.text, r.source) for r in docs.collect())
    assert all(n <= 3 * rowcount[k] for k, n in times.items())
    assert mixing.mix(spark, empty(spark)).count() == 0 and mixing.mixed_documents(spark, empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "en", "s", 1), (2, "", "en", None, 1)], DOC)
    assert [r.taken for r in mixing.mix(spark, blank).collect()] == [0, 0]


def test_tokenizer_equals_the_library():
    t, own = Tokenizer.from_file(PATH), WordTokenizer(open(PATH, encoding="utf-8").read())
    texts = [r[1] or "" for r in rows()] + ["a<|endoftext|>b <|startoftext|>", "İstanbul ΑΣ ﬁ x\x1cy é  z don't IT'S a''s 12ab", "e\u0301 \u0301x \xa0 \u3000 日本", "<|end", "'s's ''ll ŉ ß ẞ"]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from the cache
        flat, n = own(pa.array(texts))
        assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == want
    own.MOST = 0
    assert own(pa.array(texts))[0].tolist() == flat.tolist()
    assert [x.tolist() for x in own(pa.array([], pa.string()))] == [[], []]


def check(pieces, texts):
    """Every id of every document in exactly one piece; windows gapless; padding little."""
    t = Tokenizer.from_file(PATH)
    by_doc, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        windows[p.sequence_id].append(p)
    for doc_id, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding, windows


def test_pack_covers_every_id_once(spark):
    texts = {r[0]: r[1] for r in rows() if r[0] is not None and r[0] != 160}
    docs = plain(spark).where("doc_id is not null and doc_id != 160")
    got = packing.pack(spark, docs, PATH).collect()
    padding, windows = check(got, texts)
    assert padding <= 4096 * docs.rdd.getNumPartitions()
    steps = defaultdict(int)
    for w in windows.values():
        steps[w[0].step_group] += w[0].tier
    assert max(steps.values()) <= packing.STEP


def test_pack_of_awkward_rows(spark):
    got = packing.pack(spark, documents(spark), PATH).collect()
    assert sum(p.length for p in got) == sum(len(Tokenizer.from_file(PATH).encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows())
    assert packing.pack(spark, empty(spark), PATH).count() == 0


def test_packer_in_many_rounds(monkeypatch):
    monkeypatch.setattr(packing, "POOL", 6000)
    rng = np.random.default_rng(4)
    out = []
    packer = packing.Packer(lambda pieces, tier: out.append((pieces, tier)))
    docs = [np.arange(n, dtype="<u4").tobytes() for n in rng.integers(1, 9000, 200)]
    for i, d in enumerate(docs):
        packer.add(i, d)
    packer.pack(True)
    parts = defaultdict(dict)
    for pieces, _ in out:
        for doc_id, start, ids, _ in pieces:
            parts[doc_id][start] = ids
    assert all(b"".join(parts[i][s] for s in sorted(parts[i])) == d for i, d in enumerate(docs))
    lengths = [sum(len(p[2]) // 4 for p in pieces) for pieces, _ in out]
    assert sum(n & (n - 1) != 0 for n in lengths) <= 1
