"""Sharding, packing, chat windows, pages, licences and the codec against plain versions."""

import dataclasses
import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberwatch.llm import chat_format as cf
from emberwatch.llm import html_extract as he
from emberwatch.llm import license_scan as ls
from emberwatch.llm import packing as pk
from emberwatch.llm import sentencepiece_codec as sc
from emberwatch.llm import sharding as sh
from emberwatch.llm.common import pick
from emberwatch.llm.license_templates import TEMPLATES
from emberwatch.llm.slices import numbered, ranged


def jump(key, shards):
    """The published loop, one key at a time."""
    key %= 2**64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * sh.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_moves_only_into_new_shards():
    keys = np.array([0, 1, -1, 2**62, -(2**63), *range(5, 3000, 7)], np.int64)
    for n in (1, 2, 8, 9, 100):
        assert sh.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]
    old, new = sh.jump_hash(keys, 8), sh.jump_hash(keys, 9)
    assert set(new[old != new]) == {8} and 0.05 < (old != new).mean() < 0.2


def test_shards(docs, corpus, empty, nothing):
    out = sh.shard_documents(docs).collect()
    assert sorted((r.size, r.text_crc32) for r in out) == sorted(
        (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in corpus
    )
    slots = defaultdict(list)
    for r in out:
        assert r.shard == jump(-1 if r.doc_id is None else r.doc_id, 8) and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sh.shard_documents(empty).count() == 0
    assert sorted(r.slot for r in sh.shard_documents(nothing).collect()) == [0, 1]


def test_shards_are_written_as_folders(spark, docs, tmp_path):
    sh.write_shards(pick(docs, "doc_id", "text"), f"{tmp_path}/out", shards=4, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count() and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_numbers_within_groups(spark):
    rows = [(k % 3, None if k % 50 == 9 else k * k) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, doc_id long")
    out = numbered(ranged(df, ["doc_id"], "test"), "g", ["doc_id"], "n").collect()
    for g in range(3):
        mine = sorted((r.n, r.doc_id) for r in out if r.g == g)
        assert [n for n, _ in mine] == list(range(len(mine)))
        keys = [k for _, k in mine if k is not None]
        assert keys == sorted(keys) and [k for _, k in mine] == [None] * (len(mine) - len(keys)) + keys


def test_slices_split_equal_keys_and_missing_ones(spark, many_slices):
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k,) for k in range(3000)]
    sizes = ranged(spark.createDataFrame(rows, "doc_id long").repartition(5), ["doc_id"], "test").groupBy("slice").count().collect()
    assert max(r["count"] for r in sizes) < 1000 and sum(r["count"] for r in sizes) == 3000


# -- packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pk.default_vocabulary())


def test_packing_is_lossless(docs, corpus, tokenizer):
    placed = pk.pack_documents(docs)
    pieces = placed.collect()
    wanted = Counter()
    for i, t in corpus:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 1024):
            part = ids[s : s + 1024]
            wanted[(i, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces) == wanted
    by = defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    whole = pk.packed_sequences(placed, pk.token_pieces(docs)).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in pieces)
    assert {r.sequence_id: len(r.ids) for r in whole} == {k: sum(n for _, n in v) for k, v in by.items()}


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a\t\t" * 400_000, "x" + " " * 1_200_000 + "y"])
def test_long_runs_of_blanks_are_encoded(tokenizer, text):
    assert pk.token_ids(text, pk.default_vocabulary()) == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_of_long_runs_of_blanks(spark):
    rows = [(1, " " * 1_000_000), (2, "short"), (3, "\n" * 1_000_000)]
    placed = pk.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in placed} == {1, 2, 3}
    for d in (1, 2, 3):
        mine = [r for r in placed if r.doc_id == d]
        assert sum(r.length for r in mine) == mine[0].doc_tokens


def test_packing_without_rows(empty, nothing):
    assert pk.pack_documents(empty).collect() == []
    assert sorted((r.length, r.doc_tokens, r.offset) for r in pk.pack_documents(nothing).collect()) == [(1, 1, 0), (1, 1, 1)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_patterns_hold_every_piece_once(histogram):
    packs = pk.patterns(histogram, 64)
    held = Counter()
    for n, pack in packs:
        assert n > 0 and sum(k * v for k, v in pack.items()) <= 64
        for size, many in pack.items():
            held[size] += n * many
    assert held == Counter(histogram)
    assert len(packs) <= 4 * 64


def test_padding_is_small():
    rng = random.Random(1)
    histogram = Counter(min(1024, int(rng.lognormvariate(5.5, 1))) or 1 for _ in range(50_000))
    packs = pk.patterns(histogram)
    used = sum(k * v for k, v in histogram.items())
    assert used / (1024 * sum(n for n, _ in packs)) > 0.98


# -- chat windows

CHAT = [(1, k, r, t) for k, (r, t) in enumerate([("system", "be kind"), *[("user", "q " * 90), ("assistant", "a\\<|end|>" * 70)] * 6])]
CHAT += [(2, 0, "user", None), (2, 1, "assistant", "long " * 900), (2, 1, "assistant", "long " * 900), (2, None, None, "</s>[INST]")]
CHAT += [(None, 1, "assistant", "<\\|turn|> \\\\ <|turn|>x<|text|>"), (None, 0, "role<|text|>\n", "")]


@pytest.fixture(scope="module")
def chat(spark):
    rows = [(*r, "t", 0) for r in CHAT]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, Turn string, window int")


def ordered():
    by = defaultdict(list)
    for c, t, r, x in CHAT:
        by[c].append((t is None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}


def test_windows_restore_every_turn(chat):
    out = {r.conv_id: r for r in cf.conversation_digests(cf.format_windows(chat)).collect()}
    for c, turns in ordered().items():
        loss = "".join(x for r, x in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        want = (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (out[c].n_turns, out[c].turns_sha256, out[c].loss_chars, out[c].loss_sha256) == want


def test_windows_keep_budget_and_repeat_history(chat):
    windows = cf.format_windows(chat, budget=200, history=120).where("conv_id = 1").orderBy("window").collect()
    assert len(windows) > 3
    for w in windows:
        bodies = [p.split(cf.BODY) for p in w.formatted.split(cf.TURN)[1:]]
        assert bodies[0][0] == "system" and all(b.endswith(cf.END) for _, b in bodies)
        assert (w.repeated > 0) == (w.window > 0)
        new = [r for r, _ in bodies[w.repeated :]]
        assert new and len(w.loss_spans) == new.count("assistant")
    texts = [b for w in windows for b in w.formatted.split(cf.TURN)[1 + w.repeated :]]
    assert len(texts) == 13


def test_chat_without_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cf.conversation_digests(cf.format_windows(none)).collect() == []


@settings(max_examples=25, deadline=None)
@given(text=st.text(alphabet="\\<|/s>[INT]turn \n", max_size=40))
def test_escape_is_reversible(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(cf.escape("t").alias("e")).withColumn("u", cf.unescape("e"))
    row = df.first()
    assert row.u == text and not any(c in row.e for c in cf.CONTROL)


# -- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) x("</p>")</script></head><body class="no-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Head&shy;line &amp; more</h1></header><p>First <b>bo</b>ld&nbsp;text &lt;here&gt;<p>Second
 line<ul><li>item one<li>item <a href="x>y">two</a></ul><!-- <p>no</p> --><form><label>Name</label><input></form>
<div class="adSlot">Buy now</div><section id=comments><p>I really liked this article a lot, thanks</section></article>
<aside>Related things</aside><div id="sidebar"><p>Popular posts</div><footer>&copy; us</footer></body></html>"""


def test_page():
    assert he.main_text(PAGE).split("\n\n") == [
        "Head\xadline & more", "First bold text <here>", "Second line", "item one", "item two",
    ]


@pytest.mark.parametrize("page", [None, "", "<div", "<!--", "<p", "</p>", "<script>x", "<nav>menu</nav>", "<a href='"])
def test_pages_without_content(page):
    assert he.main_text(page) == ""


@pytest.mark.parametrize(
    "head",
    [
        "<script>for(var i=0;i<n;i++){f(i)}</script>", "<SCRIPT async>if(i<n)g('<p>no')</Script >", "<style>a<b{}</style>",
        "<title>a<b and c</title>", "<textarea>x<y</textarea>", "<script>s='</scripts>';i<n</script\n>",
        "<script><!-- w('<script>i<n</script>'); --></script>", "<script><!-->i<n</script>", "<script><!-- i<n</script>",
        "<noscript><style>a<b{}</style></noscript>", "<template><script>i<n</script>x</template>", "<svg><title>t</title></svg>",
        "<svg><style/></svg>", '<script src="x"/>',
    ],
)
def test_raw_text_ends_at_its_own_end_tag(head):
    page = f"<html><body>{head}<article><p>The text that has to stay, all of it.</p></article><script>1</script></body></html>"
    assert he.main_text(page) == "The text that has to stay, all of it."


def test_hostile_pages_end_soon():
    for page in ('<a href="' * 20_000, "<a " * 50_000, "<div>" * 20_000 + "x", "<b>" * 20_000 + "x<hr>" * 2_000, "<p>one two" * 20_000):
        he.main_text(page)
    began = time.process_time()
    he.main_text("<div>" * 20_000 + "x" + "</b></p>" * 20_000)
    assert time.process_time() - began < 5


def test_end_tags_without_partner_close_nothing():
    texts, _, parents = he.blocks("<div><p>one two</section>three four</li></p></div><p>five</p>")
    assert texts == ["one two", "three four", "five"] and parents[0] == parents[1] != parents[2]


def test_extraction_rows(spark):
    rows = [(1, "u", PAGE, "c"), (None, None, None, None), (1, "u", PAGE, "d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, Html string")
    out = he.extract_pages(df).collect()
    assert sorted(r.n_chars for r in out) == sorted([0] + [len(he.main_text(PAGE))] * 2)
    assert he.extract_pages(df.limit(0)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_cut_is_minimal(data):
    n = data.draw(st.integers(1, 7))
    costs = data.draw(st.lists(st.integers(-6, 6), min_size=n, max_size=n))
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    edges = {e: data.draw(st.integers(1, 4)) for e in pairs if data.draw(st.booleans())}

    def total(side):
        cut = sum(w for (a, b), w in edges.items() if side[a] != side[b])
        return cut + sum(max(c, 0) if not s else max(-c, 0) for c, s in zip(costs, side))

    best = min(total([bool(m >> k & 1) for k in range(n)]) for m in range(2**n))
    assert total(he.minimum_cut([float(c) for c in costs], {e: float(w) for e, w in edges.items()})) == best


# -- licences


def plain_best(text, template, least):
    w, t = ls.words_of(text), ls.words_of(template)
    pairs, own = list(zip(w, w[1:])), set(zip(t, t[1:]))
    best = 0.0
    for i in range(len(pairs)):
        for j in range(i, len(pairs)):
            best = max(best, 2 * len(own & set(pairs[i : j + 1])) / (j - i + 1 + len(own)))
    return best if best >= least else 0.0


def test_licences_equal_plain_search():
    rng = random.Random(4)
    short = [t for t in TEMPLATES if len(t[1]) < 120]
    of = ls.index(short)
    for _ in range(60):
        name, text = rng.choice(short)
        w = text.split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(["the", "license", "odd", "of"])
        page = " ".join(["some", "words"] * rng.randrange(4) + w + ["and", "the", "rest"] * rng.randrange(3))
        found = ls.find_licenses(page, of)
        best = max(plain_best(page, t, ls.LEAST) for _, t in short)
        assert (found[0][1] if found else 0.0) == pytest.approx(best)


def test_whole_licence_in_a_long_text():
    mit = dict(TEMPLATES[::-1])["MIT"]
    of = ls.index(TEMPLATES)
    (name, dice, first, last), *_ = ls.find_licenses("word " * 500 + mit.upper() + " tail" * 300, of)
    assert (name, first) == ("MIT", 500) and dice > 0.95 and last > 490 + len(ls.words_of(mit))
    assert ls.find_licenses("the software is provided and used " * 40, of) == []


def test_licence_rows(docs, corpus, empty, spark):
    assert ls.scan_licenses(docs).where("license is null and size(licenses) = 0").count() == len(corpus)
    assert ls.scan_licenses(empty).collect() == []
    df = spark.createDataFrame([(1, "x\nReleased under the MIT License.")], "doc_id long, text string")
    assert tuple(ls.scan_licenses(df).first()) == (1, "MIT", 1.0, 1, 5, ["MIT"])


# -- SentencePiece


def test_codec_agrees_and_restores(docs, corpus, empty, nothing):
    out = sc.codec_digests(docs).collect()
    assert len(out) == len(corpus) and all(r.parity for r in out)
    crc = Counter(zlib.crc32((t or "").encode()) for _, t in corpus)
    assert Counter(r.decoded_crc32 for r in out if r.round_trip) == crc
    encoded = sc.encode(docs)
    back = Counter((r.doc_id, r.text) for r in sc.decode(encoded).collect())
    assert back == Counter((i, t or "") for i, t in corpus)
    assert sc.codec_digests(empty).collect() == []
    assert [(r.n_tokens, r.round_trip) for r in sc.codec_digests(nothing).collect()] == [(0, True)] * 2


def number(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def unigram_model():
    """A small hand-written unigram model in the protobuf format."""
    import struct

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    words = ["▁", "▁the", "▁th", "e", "a", "n", "▁a", "▁an", "an", "t", "h", "na", "▁ban", "ana", "b", "s", "▁t", "he"]
    pieces += [(w, -1.0 - 0.37 * k, 1) for k, w in enumerate(words)]
    out = b""
    for text, score, kind in pieces:
        raw = text.encode()
        body = b"\x0a" + number(len(raw)) + raw + b"\x15" + struct.pack("<f", score) + b"\x18" + number(kind)
        out += b"\x0a" + number(len(body)) + body
    trainer = b"\x18\x01" + number(35 << 3) + b"\x01"
    normaliser = b"\x0a\x08identity" + b"\x18\x01\x20\x00\x28\x01"
    return out + b"\x12" + number(len(trainer)) + trainer + b"\x1a" + number(len(normaliser)) + normaliser


def test_unigram_scores_and_byte_fallback():
    import sentencepiece

    data = unigram_model()
    model = sc.parse_model(data)
    assert (model.kind, model.byte_fallback, model.dummy_prefix, model.one_space) == (sc.UNIGRAM, True, True, False)
    own, other = sc.build(model), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(6)
    texts = ["", "the banana", "an ant", "ü漢 the", "a  b", " the", "the "]
    texts += ["".join(rng.choice("abnthes ü") for _ in range(rng.randrange(30))) for _ in range(200)]
    for t in texts:
        ids = own.encode(t, add_special_tokens=False).ids
        assert ids == other.encode(t), t
        assert own.decode(ids, skip_special_tokens=False) == t


def test_bytes_that_are_no_text():
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=sc.default_model())
    lone = [other.piece_to_id("<0xE2>"), other.piece_to_id("<0x82>"), other.piece_to_id("▁a")]
    assert sc.codec(sc.default_model()).decode_batch([lone, []], skip_special_tokens=False)[0].endswith(" a")


def test_marks_set_outside_the_library_give_its_ids():
    path = sc.default_model()
    model, own, bare = sc.load(path), sc.codec(path), sc.codec(path, 1, True)
    rng = random.Random(3)
    texts = ["", " ", "  ", "\u2581", "a", " a  b ", "x\n \n y\t", "\u00a0\u3000", "<s> <0x41>", "smile \U0001F600 \u0a85"]
    texts += ["".join(rng.choice("ab  \n\u2581\u00e9\u4e2d.0") for _ in range(rng.randrange(60))) for _ in range(300)]
    assert sc.only_marks(model)
    assert [sc.mark(t, model) for t in texts] == [own.normalizer.normalize_str(t) for t in texts]
    given = bare.encode_batch_fast([sc.mark(t, model) for t in texts], add_special_tokens=False)
    assert [e.ids for e in given] == [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]
    for change in ({"charsmap": b"x"}, {"one_space": True}, {"pieces": [*model.pieces, ("new", 0.0, sc.USER_DEFINED)]}):
        assert not sc.only_marks(dataclasses.replace(model, **change))


def test_bpe_parity_on_random_strings():
    import sentencepiece

    own, other = sc.codec(sc.default_model()), sentencepiece.SentencePieceProcessor(model_file=sc.default_model())
    rng = random.Random(8)
    for _ in range(500):
        t = "".join(rng.choice("ab the,.\n\t   éß漢😀▁<>/s1") for _ in range(rng.randrange(60)))
        assert own.encode(t, add_special_tokens=False).ids == other.encode(t), repr(t)
        assert own.decode(other.encode(t), skip_special_tokens=False) == other.decode(other.encode(t))
