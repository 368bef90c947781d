import struct

import pytest

from leafpress.llm import media


@pytest.mark.parametrize(("bits", "packed"), [(4, bytes([0x12, 0x30])), (8, bytes([1, 2, 3])), (16, struct.pack(">3H", 1, 2, 3))])
def test_compact_sizes(bits, packed):
    data = memoryview(struct.pack(">III", 0, bits, 3) + packed)
    t = {"chunks": [0], "runs": [(1, 3, 1)]}
    media._field(data, b"stz2", 0, len(data), t)
    media._samples(t, 100)
    assert (t["sizes"], t["offsets"], list(t["keys"])) == ([1, 2, 3], [0, 1, 3], [0, 1, 2])


def test_stz2_is_walked(spark):
    stored = media.wrap(b"x" * 192 * 3)
    at = stored.index(b"stsz")
    (whole,) = media.tracks(stored)
    # The field that stsz has for one size is no width of compact entries: an error, where the track had no samples before.
    with pytest.raises(media.Malformed):
        media.tracks(stored[:at] + b"stz2" + stored[at + 4 :])
    with pytest.raises(media.Malformed):
        media.tracks(stored.replace(b"stsz", b"xxxx"))
    assert len(whole["sizes"]) == 3
