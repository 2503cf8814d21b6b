import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import sentencepiece_fst, token_counts, tokens

ODD = ["", None, "  hi   there ", "日本語のテキスト 😀  \n\n\t x y", "    " * 30 + "x", "a" * 3000, "don't we'll 123 456é 's''s", "▁ x ▁▁y", "▁", " ", "\x00a", "...!!!", " \n ", "<|endoftext|> hi <|endoftext|>", "a×b÷c d\x1ce"]


def random_texts(n=4000):
    rng = random.Random(5)
    letters = "aB'stremdvl  \n\t.,0<|é÷×ñßĀ 漢9 '!▁"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 24))) for _ in range(n)]


def test_column_encoder_is_the_library():
    texts = random_texts()
    t = Tokenizer.from_file(tokens.default_path())
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    encoder = tokens.ColumnEncoder()
    for _ in range(2):  # the second time from the cache
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == want
    assert [x.tolist() for x in encoder.encode(pa.array(texts).slice(7, 20))] == want[7:27]
    assert [x.tolist() for x in tokens.encode(texts)] == want
    assert list(encoder.encode(pa.array([], pa.string()))) == []


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(tokens, "COLUMN_BYTES", 200)
    texts = random_texts(500)
    t = Tokenizer.from_file(tokens.default_path())
    got = list(tokens.ColumnEncoder().encode(pa.array(texts)))
    assert all(np.array_equal(g, t.encode(x or "", add_special_tokens=False).ids) for g, x in zip(got, texts, strict=True))


def test_words_in_use_stay_in_the_cache(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encoder = tokens.ColumnEncoder()
    asked = []
    encoded = encoder._encoded
    monkeypatch.setattr(encoder, "_encoded", lambda words: asked.extend(words) or encoded(words))
    t = Tokenizer.from_file(tokens.default_path())
    for k in range(12):
        text = "x often" + "".join(f" {a}{b}" for a in "abcdefghijkl"[k] for b in "abcdefghijklmnopqrstuvwxyzßéabcd")
        assert [x.tolist() for x in encoder.encode(pa.array([text]))] == [t.encode(text, add_special_tokens=False).ids]
    assert len(asked) > 300 and sum(bytes(w.encode() if isinstance(w, str) else w) == b" often" for w in asked) == 1


def test_long_text_in_safe_parts():
    text = "word and more words. " * 40_000
    parts = tokens.safe_parts(text, 10_000)
    assert "".join(parts) == text and len(parts) > 50
    t = Tokenizer.from_file(tokens.default_path())
    assert sum((t.encode(p, add_special_tokens=False).ids for p in parts), []) == t.encode(text, add_special_tokens=False).ids


def test_trie_counts_are_the_librarys():
    texts = random_texts()
    t = Tokenizer.from_file(tokens.default_path())
    counter = token_counts.Counter(tokens.default_path())
    assert [n for n, _ in counter.count(texts)] == [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_transducer_is_the_library():
    texts = [x or "" for x in random_texts()]
    own = sentencepiece_fst.Transducer(sentencepiece_fst.default_path())
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_path())
    want = library.encode(texts, num_threads=1)
    got = [x.tolist() for x in own.encode(texts)]
    assert got == want
    assert [own.decode(x) for x in got] == [library.decode(x) for x in want]


def test_caches_never_forget_what_a_text_needs(monkeypatch):
    """Many more distinct words than a cache holds, in one text and over texts, with a trie that is planted anew."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklm漢é") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    texts = ["short one", " ".join(words), " ".join(words[::-1][:900]), "short one", " ".join(words[100:2000])]
    for module in (sentencepiece_fst, token_counts):
        monkeypatch.setattr(module, "REMEMBERED", 40)
        monkeypatch.setattr(module, "CHUNK_CHARS", 300)
    t = Tokenizer.from_file(tokens.default_path())
    counter = token_counts.Counter(tokens.default_path())
    counter.lattice.most_nodes = counter.lattice.most_pairs = 500
    assert [n for n, _ in counter.count(texts)] == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    own = sentencepiece_fst.Transducer(sentencepiece_fst.default_path())
    own.lattice.most_nodes = own.lattice.most_pairs = 500
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_path())
    assert [x.tolist() for x in own.encode(texts)] == library.encode(texts, num_threads=1)


@pytest.mark.parametrize("encoder", ["pieces", "counts"])
def test_one_text_of_very_many_words(encoder):
    """600,000 distinct words in one text, after a short one, under the real constants."""
    letters = "etaoinshrdlu"
    words = []
    for n in range(600_000):
        w = ""
        while n or not w:
            n, k = divmod(n, len(letters))
            w += letters[k]
        words.append(w + "x")
    text = " ".join(words)
    if encoder == "pieces":
        got = list(sentencepiece_fst.Transducer(sentencepiece_fst.default_path()).encode(["a b", text]))
        want = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_path()).encode(text, num_threads=1)
        assert np.array_equal(got[1], want)
    else:
        t = Tokenizer.from_file(tokens.default_path())
        got = list(token_counts.Counter(tokens.default_path()).count(["a b", text]))
        assert got[1][0] == sum(len(t.encode(p, add_special_tokens=False).ids) for p in tokens.safe_parts(text))


def test_the_minimum_is_over_all_arcs():
    """Of all arcs into every prefix one alone is finite, and it is the one that the trie keeps."""
    own = sentencepiece_fst.Transducer(sentencepiece_fst.default_path()).lattice
    for word in ("▁internationally", "▁▁▁x", "▁qzxjkv", "▁漢字漢", "▁aaaaaaaaa", "▁the", "▁unbelievable"):
        ((_, path),) = own.walk([word])
        for end in range(1, len(word) + 1):
            finite = {}
            for number, span in own.arcs(word, end):
                start = path[end - span]
                before = own.number[start]
                pair = own.pair_weight(own.pieces[before], own.pieces[number]) if before >= 0 and number >= 0 and end > span else 0
                weight = own.score[start] + pair + (1 if number >= 0 else len(word[end - 1].encode()))
                if weight < float("inf"):
                    finite[number, span] = weight
            assert finite == {(own.number[path[end]], own.span[path[end]]): own.score[path[end]]}


def test_queries_on_odd_rows(spark):
    rows = spark.createDataFrame([(i, x, "extra") for i, x in enumerate(ODD)] + [(None, "a b", "x"), (3, ODD[3], "again")], "doc_id bigint, text string, id string")
    counted = token_counts.count_tokens(rows).collect()
    assert len(counted) == rows.count() and all(r.n_tokens == 0 for r in counted if r.id in (0, 1))
    encoded = sentencepiece_fst.encode_documents(rows)
    decoded = {r.id: r.text for r in sentencepiece_fst.decode_documents(encoded).collect()}
    assert decoded[2] == ODD[2] and decoded[1] == ""
    assert {r.restored for r in sentencepiece_fst.round_trip(rows.where("not contains(text, '▁') or text is null")).collect()} == {True}
    empty = rows.where("false")
    assert token_counts.count_tokens(empty).count() == 0 and sentencepiece_fst.round_trip(empty).count() == 0
