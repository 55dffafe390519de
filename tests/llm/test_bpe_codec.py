"""Byte-pair codec against the tokenizers library."""

import hashlib
import random

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from emberwatch.llm import bpe_codec as bc


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(bc.default_vocabulary())
    out.no_truncation()
    out.no_padding()
    return out


def own_ids(text):
    return [int(i) for w in bc.codec(bc.default_vocabulary()).encode(text) for i in w.split(" ")]


def check(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert own_ids(text) == want
    decoded = bc.codec(bc.default_vocabulary()).decode(" ".join(map(str, want)))
    assert decoded == library.decode(want, skip_special_tokens=False)


AWKWARD = [
    "", " ", "\n\t ", "a", "It's THE end, isn't it? we'll 've 'S 'T", "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|><|endoftext|><|",
    "ΑΣ ΑΣΑ Σ", "İstanbul ẞ ß ŒUVRE ǅ", "é 가 á̧", "\x1c\x1d\x85\xa0 x​y", "12345 ⅷ ² x²y", "____ -- __init__",
    "漢字かな交じり文 한국어 العربية हिन्दी", "😀👍🏽👩‍👩‍👧", "\x00\x01\x7f\x80", "ᲉꟋ\U00016121 new letters", "don''t 'lltre's", "ﬁ K Å",
]


@pytest.mark.parametrize("text", AWKWARD)
def test_awkward_texts(library, text):
    check(library, text)
    check(library, text + " x " + text.upper())


@settings(deadline=None, max_examples=400)
@given(st.text(max_size=60))
@example("\U0001e5ffͅ")
def test_any_text(library, text):
    check(library, text)


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="aenrst'ë ", max_size=60))
def test_words_of_few_letters(library, text):
    check(library, text)


def test_every_character(library):
    """Alone, after a letter and between digits; in the library's own classes and cases."""
    for lo in range(0, len(bc.ALL), 2048):
        part = [chr(c) for c in bc.ALL[lo : lo + 2048]]
        check(library, " ".join(f"a{c} {c} 1{c}2" for c in part))
        check(library, "".join(part))


def test_latin_texts_take_the_same_way():
    own, text = bc.codec(bc.default_vocabulary()).bpe, "".join(map(chr, range(256))) * 2
    every, small = bc.word_patterns()
    assert bc.latin(text) and every.findall(text.lower()) == small.findall(text.lower()) == own.words(text)
    assert not bc.strangers().search(text)


def test_very_long_texts(library):
    rng = random.Random(1)
    for text in ("x" * 60_000, "".join(rng.choice("abcdef") for _ in range(60_000)), " " * 1_000_000, "\n" * 1_000_000, "-" * 30_000):
        check(library, text)


def test_put_keeps_the_least_of_every_span():
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 8, 50):
        leaves = [rng.randrange(100) for _ in range(n)]
        cells = bc.segment_tree(list(leaves), 100)
        for _ in range(200):
            i = rng.randrange(n)
            leaves[i] = rng.choice([100, rng.randrange(100)])
            bc.put(cells, len(cells) // 2 + i, leaves[i])
            assert cells[1] == min(leaves) and all(cells[k] == min(cells[2 * k : 2 * k + 2]) for k in range(1, len(cells) // 2))


def test_memory_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(bc, "KEPT_WORDS", 3)
    calls = []
    kept = bc.Memory(lambda w: calls.append(w) or w.upper())
    words = ["a", "b", "a", "c", "d", "a", "b", "e", "f", "g", "h", "a", "x" * 100, "x" * 100]
    assert [kept[w] for w in words] == [w.upper() for w in words] and len(kept) <= 3 and len(calls) < len(words)
    assert "x" * 100 not in kept


def test_tables(spark, docs, corpus, empty, nothing, library):
    texts = [t or "" for _, t in corpus]
    ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [
        (d, len(i), sha(" ".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))) for (d, _), i in zip(corpus, ids)
    ]
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bc.bpe_digests(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    encoded = bc.encode(docs)
    assert sorted((str(r.doc_id), r.ids) for r in encoded.collect()) == sorted((str(d), i) for (d, _), i in zip(corpus, ids))
    back = sorted((str(r.doc_id), r.text) for r in bc.decode(encoded).collect())
    assert back == sorted((str(d), library.decode(i, skip_special_tokens=False)) for (d, _), i in zip(corpus, ids))
    assert bc.bpe_digests(empty).count() == 0 and [r.n_tokens for r in bc.bpe_digests(nothing).collect()] == [0, 0]


def test_other_layouts_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError):
        bc.WordBPE(public_tokenizers.path("byte_bpe_50k.json"))
