import pytest

from photonlake.functions import captions, text

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")

#: Texts and their published ids.
KNOWN = {
    "a photo of a cat": [320, 1125, 539, 320, 2368],
    "Two astronauts! in   SPACE, 2024 — café naïve": [1237, 29733, 256, 530, 2138, 267, 273, 271, 273, 275, 2005, 15304, 1097, 35689, 563],
    "emoji \U0001f4f7 and 日本語 text": [16327, 5551, 537, 39121, 44353, 34002, 508, 4160],
    "don't won't I'll they're &amp; co": [847, 713, 1749, 713, 328, 1342, 889, 982, 261, 1320],
    "café au lait": [15304, 2566, 572, 585],
    "“midnight protest” at the ‘old’ mill": [257, 6302, 6279, 257, 536, 518, 262, 896, 262, 6637],
    "ﬁre ﬂag ﬃce ĳsselmeer": [1769, 4859, 26044, 7337, 17402, 27555],
    "ＦＩＲＥ at １２am　！": [1769, 536, 272, 273, 687, 256],
    "cafÃ© terrace": [15304, 13820],
    "itâ€™s raining": [585, 568, 13964],
    "SÃO PAULO street": [45911, 21628, 2012],
}


@pytest.mark.parametrize("s", KNOWN)
def test_published_ids(s):
    assert captions.body_ids(s, PATH) == KNOWN[s]


def test_windows(spark):
    df = spark.createDataFrame([("a photo of a cat",), ("word " * 200,), (None,)], "t string")
    got = [r.v for r in df.select(captions.caption_ids(df["t"], PATH).alias("v")).collect()]
    assert got[0][:7] == [49406, 320, 1125, 539, 320, 2368, 49407] and got[0][7:] == [0] * 70
    assert len(got[1]) == 77 and got[1][-1] == 49407 and got[2] is None


def test_repair_leaves_real_text():
    assert text.repair_mojibake("SÃO") == "SÃO" and text.repair_mojibake("plain") == "plain"
