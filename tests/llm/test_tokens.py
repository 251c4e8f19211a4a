"""The shared encoder: what it asks of the library, and that this changes no id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from shopmeld.llm.tokens import Encoder, cut, public_file

LATIN = [chr(c) for c in [*range(33, 127), *range(0xC0, 0x250)]]


class Counting:
    """A tokenizer that notes how many texts it is given at once."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.asked += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def check(own, texts):
    ids, begin = own.encode(pa.array(texts))
    library = getattr(own.tokenizer, "tokenizer", own.tokenizer)
    for i, text in enumerate(texts):
        assert ids[begin[i] : begin[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_words_are_encoded_many_to_a_text(name):
    rng = np.random.default_rng(7)
    texts = [" ".join("".join(rng.choice(LATIN, n)) for n in rng.integers(1, 9, 100)) + " it's 中. ° x" for _ in range(40)]
    own = Encoder(public_file(name))
    own.tokenizer = Counting(own.tokenizer)
    check(own, texts)
    assert len(own.known) > 2000 and own.tokenizer.asked < 20
    asked = own.tokenizer.asked
    check(own, texts[::-1])
    assert own.tokenizer.asked == asked


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("mark, mark_id", [(None, None), ("\n0\n", 15), ("", 0)])
def test_marks_that_do_not_come_back_change_nothing(name, mark, mark_id):
    own = Encoder(public_file(name))
    own.mark, own.mark_id = mark, mark_id
    check(own, ["the 0 00 birds, 0", "a\nb c", "it's 10 and 0.", "0 0 0\n0"])


def test_steps_take_columns_with_nulls_and_slices():
    own = Encoder(public_file("word_bpe_49k.json"))
    column = pa.array(["left out", None, "", "a b\n c", " odd  one\x01", "a b"]).slice(1)
    ((start, stop, ids, begin),) = own.encode_steps(column)
    assert (start, stop, begin[0], begin[2], begin[-1]) == (0, 5, 0, 0, len(ids))
    pieces = cut(column.fill_null("").cast(pa.large_string())).to_pylist()
    assert ["".join(x) for x in pieces] == column.fill_null("").to_pylist() and pieces[-1] == ["a", " b"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_runs_of_letters_are_parted_from_punctuation_and_go_to_the_model_alone(name):
    rng = np.random.default_rng(3)
    letters = [c for c in LATIN if c.isalpha() and c <= "ÿ"]
    runs = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 12, 1500)]
    texts = [" ".join(run + rest for run in runs) for rest in ("", ",", ".", "?!", "-", "...)")]
    own = Encoder(public_file(name))
    own.tokenizer = Counting(own.tokenizer)
    check(own, texts)
    assert len(own.known) > 8000 and own.tokenizer.asked <= 2
    check(own, ["it's x's, 's 't can't. a,b a,'s I'LL O'Neill\nÉcole,\nß ÿ' İstanbul ſ. a1 á, Ċ a Ċb"])


@pytest.mark.parametrize("pattern", ["[A-Z]?[a-z]+", "[a-z]{1,30}", "[a-zà-ÿ]+,?"])
def test_files_that_part_runs_otherwise_keep_the_library_s_words(pattern, tmp_path):
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    other = Tokenizer.from_file(public_file("byte_bpe_50k.json"))
    other.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern + "| "), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    other.save(str(tmp_path / "other.json"))
    own = Encoder(str(tmp_path / "other.json"))
    assert own.bare is None
    check(own, ["camelCaseWords, theQuick, word, " + "long" * 20, "the, quick. Ébc,"])
