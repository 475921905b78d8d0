import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.common import Encoder, default_tokenizer
from tessera.llm.token_files import decode_file, encode_file

ENCODER = Encoder(default_tokenizer(), room=200)
PARTS = ["word", " it's", "'", "'stuff", " ", "  ", "\n", "\n\n", "\t", "é", "中文", "don't", "12", " 3", "***", "!?", "<|endoftext|>", " ", " ", "\x01", "×", "ǅ", "á", "😀", "_x", "AKIA", ".", "\x1c"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=4)), max_size=24).map("".join))
def test_pieces_encode_as_whole_text(text):
    want = np.array(ENCODER.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
    assert ENCODER.encode(text) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=3000), st.integers(50, 100))
def test_files_round_trip(ids, percentile):
    cuts = sorted({0, len(ids) // 3, len(ids) // 2})
    docs = [None if k == 1 else k - 5 for k in range(len(cuts))]
    out, names, starts, before = decode_file(encode_file(np.array(ids, np.uint32), docs, cuts, before=9, percentile=percentile))
    assert out.tolist() == ids and names == docs and starts.tolist() == [*cuts, len(ids)] and before == 9


def test_other_bytes_are_refused():
    with pytest.raises(ValueError):
        decode_file(b"x" * 64)
