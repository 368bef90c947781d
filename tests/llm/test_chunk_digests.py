from leafpress.llm import chunks


def test_digests_hold_over_a_corpus():
    (found,) = chunks.fingerprints([b"some words of a text that has a few chunks, " * 9])
    assert found and all(len(k) == 16 for k in found)
