import random

import pytest

import corpus_pipeline
from leafpress.llm import shingles


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def brute(rows, like):
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if i < j and jaccard(a, b) >= like:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return sorted(i for i in root if root[i] == i)


@pytest.fixture(scope="module")
def rows():
    """Copies with 0 to 4 words changed, texts around one long passage, short and empty ones."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    passage, texts = [word() for _ in range(60)], ["", "", "One two", "one  TWO", "one three"]
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(20, 150))]
        for changed in range(5):
            text = list(base)
            for _ in range(changed):
                text[rng.randrange(len(text))] = word()
            texts.append(" ".join(text))
    texts += [" ".join([word() for _ in range(rng.randrange(2, 30))] + passage) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("crowd", [0, 3, shingles.CROWD])
@pytest.mark.parametrize("like", [0.6, 0.8])
def test_recall(spark, rows, crowd, like):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.keep_one(table, like=like, crowd=crowd).collect()) == brute(rows, like)


def test_stage(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, table, "").collect()) == brute(rows, 0.8)


def test_odd(spark, odd, empty):
    assert shingles.keep_one(empty).count() == 0
    kept = shingles.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 3, 5, 6, None]
