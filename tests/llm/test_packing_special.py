import numpy as np
import pytest

from cohortflow.llm import packing


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|startoftext|>a thing's end<|endoftext|>\nb", "x<|endoftext|><|endoftext|>, y", "<|EndOfText|> <|end of"])
def test_special_tokens_as_the_untouched_tokenizer(text):
    from tokenizers import Tokenizer
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = whole.encode(text, add_special_tokens=False).ids
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.WordIds().encode([text])] == [ids]
