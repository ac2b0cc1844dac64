import os
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracelake.llm import packing, record_files, sentencepiece_unigram, token_counts
from tracelake.llm.bpe import Encoder, Vocabulary
from tracelake.llm.common import scratch

from .conftest import MESSY

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def library(vocab):
    return Tokenizer.from_file(vocab)


@pytest.fixture(scope="module")
def encoder(vocab):
    return Encoder(Vocabulary(vocab).text)


@pytest.fixture(scope="module")
def counter(vocab):
    return token_counts.Counter(Vocabulary(vocab).text)


TEXTS = st.text(alphabet=st.sampled_from(list("aAbBté 'sdmrvl\n\t\r\x0b\x1c\x85\xa0.!?9²ª–“漢\U0001f600<|>endoftx")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_encoder_and_counter_equal_the_library(library, encoder, counter, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.many([text])[0], encoder.dtype).tolist() == want
    assert counter(text) == len(want)


SCRIPTS = st.lists(st.sampled_from(["Привет", "мир", "漢字", "かな", "\U0001f600", "\U0001f44d\U0001f3fd", "العربية", "हिन्दी", "한국어", "<|endoftext|>", "١٢", "½²", "Ⅷ", "\u3000", "\u2003", "\U00010400", "'ll", "a", " ", "\n", "_", "\u0378"]), max_size=20)


@settings(max_examples=300, deadline=None)
@given(SCRIPTS)
def test_texts_of_any_script_equal_the_library(library, encoder, counter, parts):
    text = "".join(parts)
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.many([text])[0], encoder.dtype).tolist() == want
    assert counter(text) == len(want)


def test_texts_of_any_script_are_counted_by_the_method(counter):
    from tracelake.llm.bpe import pretokens

    assert pretokens("Привет, 漢字 \U0001f600<|endoftext|>", counter.specials) == ["Привет", ",", " 漢字", " \U0001f600", "<|endoftext|>"]
    assert pretokens("a\u0378", counter.specials) is None


def test_long_pretokens_take_little_time(library, counter):
    import random
    import time

    word = "".join(random.Random(5).choices("acgtACGT", k=32_000))
    began = time.perf_counter()
    n = counter(word)
    assert time.perf_counter() - began < 2
    assert n == len(library.encode(word, add_special_tokens=False).ids)


def test_memo_forgets_without_changing_results(library, encoder, monkeypatch):
    monkeypatch.setattr("tracelake.llm.bpe.MEMO_ENTRIES", 4)
    texts = [f"word{k} and again word{k % 3}" for k in range(50)]
    for _ in range(2):
        got = [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.many(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_whole_tokens_are_proven(library, counter):
    assert len(counter.whole) > 40_000
    some = list(counter.whole)[:: len(counter.whole) // 500]
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in some)


def test_other_vocabulary_goes_through_the_library():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    text = Vocabulary(path).text
    lib = Tokenizer.from_file(path)
    for t in ("Hello the World", "", "a  b\nc"):
        want = lib.encode(t, add_special_tokens=False).ids
        e = Encoder(text)
        assert np.frombuffer(e.many([t])[0], e.dtype).tolist() == want
        assert token_counts.Counter(text)(t) == len(want)


def test_counts(messy, none, vocab, library):
    got = token_counts.count_tokens(messy, vocab, limit=10).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in MESSY]
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == Counter(want)
    assert all(r["over_limit"] == (r["n_tokens"] > 10) for r in got)
    assert token_counts.count_tokens(none, vocab).collect() == []


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_records_round_trip(spark, messy, vocab, library):
    path = scratch(spark, "test-records")
    record_files.write_records(messy, vocab, path, rows_per_shard=4)
    index = record_files.with_starts(record_files.build_index(spark, path, path + "-index")).collect()
    order = sorted(MESSY, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    by = {}
    for i, t in order:
        ids = [*ids_of(library, t), 2]
        by.setdefault((i, start), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert {(r["doc_id"], r["start"]): r["ids_crc32"] for r in index} == by
    read = {(r["doc_id"], bytes(r["ids"])) for r in record_files.read_records(spark, path).collect()}
    assert read == {(i, struct.pack(f"<{len(x)}I", *x)) for i, t in MESSY for x in [[*ids_of(library, t), 2]]}
    raw = spark.read.parquet(path + "-index")
    one, other = (record_files.read_shuffled(spark, path, raw, s).collect() for s in (1, 2))
    assert Counter(r["doc_id"] for r in one) == Counter(i for i, _ in MESSY)
    assert [bytes(r["ids"]) for r in one] != [bytes(r["ids"]) for r in other]


def test_record_digests_of_nothing(none, vocab):
    assert record_files.record_digests(none, vocab).collect() == []


def test_frames_are_checked():
    for small in (True, False):
        ids = np.array([1, 2, 65535, 10], dtype="<u2" if small else "<u4").tobytes()
        data = record_files.frame(-7, ids, small) + record_files.frame(None, b"", small)
        end, doc_id, back = record_files.read_frame(data, 0)
        assert doc_id == -7 and np.frombuffer(back, "<u4").tolist() == [1, 2, 65535, 10]
        assert record_files.read_frame(data, end) == (len(data), None, b"")
        for at in range(end - 1):
            broken = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
            with pytest.raises(ValueError):
                record_files.read_frame(broken, 0)
        with pytest.raises(ValueError):
            record_files.read_frame(data[: end - 6], 0)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plan_gives_every_rank_a_place(histogram):
    slots, made = packing.plan(histogram, 32)
    bins: dict[int, list] = {}
    ranks: dict[int, list] = {}
    for s in slots:
        for k in range(s.bins * s.each):
            bins.setdefault(s.sequence + k // s.each, []).append((s.offset + k % s.each * s.length, s.length))
            ranks.setdefault(s.length, []).append(s.rank + k)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    assert sorted(bins) == list(range(made))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 32
    # No worse than first-fit decreasing document by document.
    rooms: list[int] = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            fit = next((k for k, r in enumerate(rooms) if r >= n), None)
            if fit is None:
                rooms.append(32 - n)
            else:
                rooms[fit] -= n
    assert made <= len(rooms) + 1


def test_plan_does_not_grow_with_documents():
    few, _ = packing.plan({n: 10 for n in range(1, 1025)})
    many, made = packing.plan({n: 10_000_000 for n in range(1, 1025)})
    assert len(many) < 4 * 1024 * 4 and len(many) <= 4 * len(few)
    assert made >= sum(n * 10_000_000 for n in range(1, 1025)) // 1024


def test_packing(messy, none, vocab, library, spark):
    got = packing.pack(messy, vocab).collect()
    digests = packing.pack_digests(messy, vocab).collect()
    want = Counter()
    for i, t in MESSY:
        ids = [*ids_of(library, t), 2]
        at = 0
        while at < len(ids):
            n = (len(ids) - at) % 1024 or 1024
            want[i, at, struct.pack(f"<{n}I", *ids[at : at + n])] += 1
            at += n
    assert Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in got) == want
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in digests) == Counter({(i, s, zlib.crc32(b)): n for (i, s, b), n in want.items()})
    for rows in (got, digests):
        bins: dict[int, list] = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 1024
    full = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packing.pack(messy, vocab)).collect()}
    assert sum(map(len, full.values())) == 4 * sum(r["length"] for r in got)
    assert packing.pack_digests(none, vocab).collect() == []


def test_joining_by_shuffle_packs_the_same(messy, vocab, monkeypatch):
    one = packing.pack_digests(messy, vocab).collect()
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    two = packing.pack_digests(messy, vocab).collect()
    assert Counter(r["ids_crc32"] for r in one) == Counter(r["ids_crc32"] for r in two)
    assert len({r["sequence_id"] for r in one}) == len({r["sequence_id"] for r in two})


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return path, f.read()


def test_unigram_equals_the_library(model):
    import sentencepiece

    u = sentencepiece_unigram.Unigram(model[1])
    # The same pieces and scores under the unigram rule; its lattice gives the best segmentation.
    lib = sentencepiece.SentencePieceProcessor(model_proto=model[1] + b"\x12\x02\x18\x01")
    for text in ("The and attion to thanedble the, anea.", "Nicht aulich für sch erüver", "a  b", "Hello   world", "x"):
        ids = np.frombuffer(u.encode(text)[0], "<u4").tolist()
        best = lib.nbest_encode(text, nbest_size=4)[0]
        total = lambda seq: sum(u.scores[k] for k in seq)
        assert total(ids) == total(best)
        assert u.decode(u.encode(text)[0]) == lib.decode(ids) == text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcd ▁", max_size=9))
def test_viterbi_finds_the_best(text):
    pieces = [("▁", -2.0), ("a", -3.0), ("b", -3.5), ("ab", -4.0), ("▁a", -2.5), ("abc", -7.0), ("c", -1.0), ("bc", -4.25), ("▁▁", -3.75)]
    u = tiny(pieces)

    def segmentations(s):
        if not s:
            yield 0.0
        for n in range(1, len(s) + 1):
            own = dict(pieces).get(s[:n])
            if own is not None:
                yield from (own + rest for rest in segmentations(s[n:]))
            elif n == 1:
                yield from (u.floor + rest for rest in segmentations(s[1:]))

    ids, score, _ = u.encode(text)
    assert score == pytest.approx(max(segmentations(u.marked(text))))
    assert u.decode(ids) == text.replace("▁", " ")


def tiny(pieces):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    def piece(p, score, kind):
        body = b"\x0a" + varint(len(p)) + p + b"\x15" + struct.pack("<f", score) + b"\x18" + varint(kind)
        return b"\x0a" + varint(len(body)) + body

    data = piece(b"<unk>", 0.0, 2) + b"".join(piece(b"<0x%02X>" % b, 0.0, 6) for b in range(256))
    data += b"".join(piece(p.encode(), s, 1) for p, s in pieces)
    return sentencepiece_unigram.Unigram(data + b"\x1a\x04\x18\x01\x20\x00")


def test_trie():
    words = [b"a", b"ab", b"abc", b"\xff\x00", b"b", "漢".encode()]
    trie = sentencepiece_unigram.DoubleArray(words)
    for text in (b"abcd", b"\xff\x00x", b"b", b"zz", b"", "漢字".encode()):
        assert sorted(trie.prefixes(text)) == sorted((len(w), k) for k, w in enumerate(words) if text.startswith(w))


def test_sentencepiece_tables(messy, none, model):
    got = sentencepiece_unigram.round_trip(messy, model[0]).collect()
    assert len(got) == len(MESSY) and all(r["decodes_to_text"] for r in got)
    encoded = sentencepiece_unigram.encode_documents(messy, model[0])
    back = Counter((r["doc_id"], r["text"]) for r in sentencepiece_unigram.decode_documents(encoded, model[0]).collect())
    assert back == Counter((i, t or "") for i, t in MESSY)
    assert [r["n_pieces"] for r in got if r["doc_id"] in (1, 2)] == [0, 0]
    assert sentencepiece_unigram.round_trip(none, model[0]).collect() == []
