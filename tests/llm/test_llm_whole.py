"""Operators on rows that a cut of the work would miss."""

import random


def words(r, n, vocabulary=5000):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_drops_near_copies_from_0_8(spark, documents):
    import corpus_pipeline as pipeline

    r = random.Random(4)
    rows, near = [], 0
    for i in range(60):
        base = words(r, r.randrange(30, 300))
        rows.append((i * 10, " ".join(base)))
        for j in range(1, 5):
            text = list(base)
            for _ in range(r.randrange(1, max(2, len(base) // 30))):
                text[r.randrange(len(text))] = "new"
            rows.append((i * 10 + j, " ".join(text)))
    # a large group whose sizes differ, exact copies, and texts that share a line
    base = words(r, 200)
    rows += [(1000 + i, " ".join(base[: 200 - i % 30] + words(r, i % 7))) for i in range(60)]
    rows += [(1100 + i, " ".join(base)) for i in range(20)]
    rows += [(1200 + i, " ".join(base[:20] + words(r, 20))) for i in range(30)]
    rows += [(1300, None), (1301, " "), (None, " ".join(base))]
    sets = {i: shingles(t or "") for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or (x | y and len(x & y) / len(x | y) >= 0.8):
                near += 0.8 <= len(x & y) / max(1, len(x | y)) < 0.99
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    assert near > 100
    out = pipeline.drop_near_duplicates(spark, documents(rows, extra=False).repartition(7), "")
    got = [x["doc_id"] for x in out.select("doc_id").collect()]
    assert sorted(i for i in got if i is not None) == [i for i in ids if find(i) == i]
    assert got.count(None) == 1
