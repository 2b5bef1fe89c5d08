import numpy as np
import public_tokenizers
import pyarrow as pa
from corpus import DOCUMENTS, lower_words, words
from fabtrail.llm import words as W
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [t for _, t, _ in DOCUMENTS] + [
    "ÉCOLE, straße. naïve.,, o'clock don't we'll x's 's",
    "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b",
    "é É K İ ς ΣΑΣ 日本語 ½ a b a b",
    "end. end, end.. end., and and, AND. þÞ÷× ÿ",
]


def test_ids_are_those_of_the_tokenizer(monkeypatch):
    tokenizer = Tokenizer.from_file(PATH)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in TEXTS]
    for remembered in (10**6, 3):
        monkeypatch.setattr(W, "REMEMBERED_WORDS", remembered)
        encoder = W.WordEncoder(PATH)
        for _ in range(3):
            ids, bounds = encoder.encode(pa.array(TEXTS, pa.string()), 2)
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
        one = [encoder.encode(pa.array([t], pa.string()), 2)[0].tolist() for t in TEXTS]
        assert one == want


def test_every_letter_of_the_short_way():
    tokenizer = Tokenizer.from_file(PATH)
    encoder = W.WordEncoder(PATH)
    for c in range(0x41, 0x100):
        for word in (chr(c), chr(c) + "a", "b" + chr(c) + "x.,"):
            if words(word) == [word]:
                assert encoder.encode(pa.array([word]), 2)[0].tolist()[:-1] == tokenizer.encode(word, add_special_tokens=False).ids


def test_words_and_hashes():
    flat, bounds = W.split_words(pa.array(TEXTS, pa.string()), lower=True)
    got = [flat[a:b].to_pylist() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
    assert got == [lower_words(t) for t in TEXTS]
    distinct = flat.unique()
    hashes = W.hash_words(distinct)[0]
    assert len(np.unique(hashes)) == len(distinct)
    assert np.array_equal(hashes[2:], W.hash_words(distinct.slice(2))[0])
    assert not np.intersect1d(hashes, W.hash_words(distinct, (1,))[0]).size


def test_slices_hold_every_row():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(TEXTS, pa.string()), "k": pa.array(range(len(TEXTS)))})
    for limit in (1, 50, 10**9):
        assert [k for part in W.text_slices(batch, limit=limit) for k in part.column("k").to_pylist()] == list(range(len(TEXTS)))


def test_each_word_is_encoded_once():
    """Words with and without commas and full stops share one call of the model."""
    from types import SimpleNamespace

    import public_tokenizers

    from fabtrail.llm.words import WordEncoder

    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer, asked = encoder._tokenizer, []

    def tokenize(word):
        asked.append(word)
        return tokenizer.model.tokenize(word)

    encoder._tokenizer = SimpleNamespace(model=SimpleNamespace(tokenize=tokenize), encode=tokenizer.encode)
    texts = pa.array(["was, Was was. it É.", None, "so, so... wa,s it,. ., É it's"])
    ids, bounds = encoder.encode(texts, 2)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts.to_pylist()]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    assert len(asked) == len(set(asked))


def test_words_with_any_punctuation_share_one_call():
    """The letters of a word are encoded once whatever ASCII punctuation ends it, and each end once in a slice."""
    import string
    from types import SimpleNamespace

    encoder = W.WordEncoder(PATH)
    tokenizer, asked, whole = encoder._tokenizer, [], []

    def tokenize(word):
        asked.append(word)
        return tokenizer.model.tokenize(word)

    def encode(word, **options):
        whole.append(word)
        return tokenizer.encode(word, **options)

    encoder._tokenizer = SimpleNamespace(model=SimpleNamespace(tokenize=tokenize), encode=encode)
    ends = [*string.punctuation, "", "!!", "&&&", ",***", "'", "''", "'!", ".'", "<|", "|>", "<||>"]
    texts = pa.array([" ".join(w + e for w in ("enach", "Übeñ") for e in ends), "enach$$$", None])
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts.to_pylist()]
    for _ in range(2):
        ids, bounds = encoder.encode(texts, 2)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    # upper-case letters beyond ASCII are another word until the model lowers them
    assert len(asked) == 2 and len(encoder._keys) == 2
    assert set(whole) == set(ends + ["$$$"]) - {""} and len(whole) == 2 * len(set(whole))
