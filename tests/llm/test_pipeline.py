"""The whole pipeline against a plain version of its stages."""

import collections
import random
import zlib

import corpus_pipeline
from skeinwork.llm import packing


def test_run(spark, tmp_path):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))
    items = [words(30) for _ in range(4)]
    passage = words(70)
    texts = [words(rng.randint(20, 120)) for _ in range(24)]
    texts += [texts[0], texts[1] + " more", texts[1] + " other", None, "", "short one"]
    held = [words(40) + " " + items[0] + " " + words(9), items[1] + " " + words(60), words(30) + " " + " ".join(w if i % 9 else "zzz" for i, w in enumerate(items[2].split(), 1))]
    texts += held + [words(50) + " " + passage + " " + words(20), passage + " " + words(80), words(90) + " " + passage]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    save = lambda name, data, schema: spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    save("documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    save("benchmark", list(enumerate(items)), "item_id long, text string")
    save("labels", [], "doc_id long, quality int, toxic int")

    # without trusted documents the first stage rejects nothing
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    left = {i: (t or "").encode() for i, t in enumerate(texts) if root[i] == i}
    width = corpus_pipeline.REPEAT_BYTES
    seen = collections.Counter(b[k : k + width] for b in left.values() for k in range(len(b) - width + 1))
    for i, b in left.items():
        gone = [False] * len(b)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = [True] * width
        left[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g)
    assert sum(len(left[i]) < len((texts[i] or "").encode()) for i in left) == 3
    contaminated = {texts.index(t) for t in held}
    enc = packing.encoder(packing.default_tokenizer())
    want = {i: [*enc.plain([b.decode()])[0], 1] for i, b in left.items() if i not in contaminated}

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(want)
    sequences = collections.defaultdict(list)
    for r in pieces:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in pieces) == sum(map(len, want.values()))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
