"""Blocks of texts in scripts with other letters or without spaces, and ids that are not integers."""

import numpy as np
import public_tokenizers as P
import pytest

from lodestrata.llm import byte_bpe, quality_crf

CHINESE = "今天天气很好，我们去公园散步。孩子们在草地上玩耍、唱歌；大人们聊天！你呢？"
ARABIC = "ذهب الولد إلى المدرسة، ثم عاد إلى البيت؛ هل أكل؟ نعم۔ "
MIXED = "naïve Ünïcode été 123 ١٢٣ नमस्ते दुनिया। 안녕하세요 세계 it's 中文'字 x。y 。。 ，a\n"


@pytest.mark.parametrize("size", [1, 5, 33, 200])
def test_blocks_of_any_script_change_no_id(size):
    encoding = byte_bpe.encoding_of(byte_bpe.file_bytes(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    rng = np.random.default_rng(9)
    chars = list(CHINESE + ARABIC + MIXED + "  '’_-\t 　²ⅣⅣ〇ª゠ー々")
    for text in [CHINESE * 9, ARABIC * 9, MIXED * 9, *["".join(rng.choice(chars, 300)) for _ in range(60)]]:
        assert "".join(byte_bpe.blocks(text, size)) == text
        assert byte_bpe.encode(encoding, text, size).tolist() == encoding.encode_ordinary(text)


@pytest.mark.parametrize("text", [CHINESE, ARABIC, "éa öb "])
def test_long_texts_of_other_scripts_are_cut(text):
    assert max(map(len, byte_bpe.blocks(text * 500, 100))) < 200


def test_ids_may_be_texts(spark):
    rows = [(f"d{i}", "good words in a line\n" * 3 if i % 2 else "$$$ %%% &&&\n" * 3) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(60)], "doc_id string, quality int")
    got = {r.doc_id: r for r in quality_crf.classify(docs, labels).collect()}
    assert len(got) == 60 and sum(r.predicted == int(k[1:]) % 2 for k, r in got.items()) > 50
