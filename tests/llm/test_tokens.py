import hashlib
import random
import zlib

import numpy as np
import pytest

from claimgrid.llm import packed, token_counts, transducer
from claimgrid.llm.vocabulary import library, place, spaced_chunks, vocabulary
from tests.llm.helpers import awkward, table

ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "\xa0", "é", "é", "́", "'s", "'LL", "1", "22", "中文", "!", "?!", "<|endoftext|>",
            "<|startoftext|>", "<|endo", "ing", "the", "\r\n", "\x1c", "\x85", "　", "😀", "‍", "İ", "ß", "ΑΣ", "Σ ", "\x00", "aaaa", "ŉ", "ǅ", "_"]


def texts(seed, n=1500):
    rng = random.Random(seed)
    out = ["".join(rng.choices(ALPHABET, k=rng.randrange(0, 25))) for _ in range(n)]
    return [*out, "", "a" * 4000, "ab" * 1500, "".join(rng.choice("aeinrst") for _ in range(6000)), "=" * 900 + "-" * 900, "x\n\n  y \n z"]


def ids_of(name, text):
    return library(place(name)).encode(text, add_special_tokens=False).ids


def test_counts_equal_the_library(spark):
    own = texts(1)
    got = {r.doc_id: r for r in token_counts.counts(awkward(table(spark, own))).collect()}
    for i, t in enumerate(own, 1):
        n = len(ids_of("word_bpe_49k.json", t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 2048), repr(t[:80])


def test_rank_synchronous_merging_equals_one_pair_at_a_time():
    merges = token_counts.Merges(vocabulary(place("word_bpe_49k.json")))
    rank = dict(zip(merges.keys.tolist(), zip(merges.ranks.tolist(), merges.results.tolist())))
    rng = random.Random(3)
    rows = [[rng.randrange(64, 90) for _ in range(rng.randrange(0, 30))] for _ in range(200)] + [[64] * 9, []]
    left, sizes = merges.reduce(np.array([x for r in rows for x in r], dtype=np.int64), np.array([len(r) for r in rows]))
    want = []
    for row in rows:
        row = list(row)
        while (best := min(((*rank[k], i) for i, (a, b) in enumerate(zip(row, row[1:])) if (k := a << 32 | b) in rank), default=None)):
            row[best[2] : best[2] + 2] = [best[1]]
        want.append(row)
    assert sizes.tolist() == [len(r) for r in want] and left.tolist() == [x for r in want for x in r]


def test_transducer_equals_the_library_and_decodes(spark):
    own = texts(2)
    got = {r.doc_id: r for r in transducer.round_trip(awkward(table(spark, own)), ids=True).collect()}
    tool = library(place("byte_bpe_50k.json"))
    for i, t in enumerate(own, 1):
        ids = ids_of("byte_bpe_50k.json", t)
        assert got[i].ids == ids, repr(t[:80])
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert got[i].same_text and got[i].n_tokens == len(ids)


def test_transducer_emits_early_and_holds_little():
    own = transducer.encoder(place("byte_bpe_50k.json")).transducer
    rng, taken = random.Random(5), [0]

    def symbols():
        for _ in range(20_000):
            taken[0] += 1
            yield rng.choice("aeinrst")

    given = most = 0
    for token in own.stream(symbols()):
        most = max(most, taken[0] - given)
        given += len(own.text[token])
    assert own.lookahead == 128 and given == 20_000
    assert most <= 2 * (own.lookahead + transducer.STRIDE)
    first = next(own.stream(iter("abc" * 10_000)))
    assert first == ids_of("byte_bpe_50k.json", "abc" * 200)[0]


def test_decoding_is_incremental():
    decode = transducer.decoder(place("byte_bpe_50k.json"))
    rng = random.Random(8)
    ids = np.array([rng.randrange(50_257) for _ in range(3000)])
    whole = library(place("byte_bpe_50k.json")).decode(ids.tolist(), skip_special_tokens=False)
    assert decode.decode(ids, part=7) == whole == decode.decode(ids)


def test_chunks_join_to_the_text():
    for t in texts(4, 300):
        assert "".join(spaced_chunks(t)) == t


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 24, 31, 32])
def test_packing_round_trips(bits, tmp_path):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 5000, 3, 0, 12_000, 7)]
    ids = [None, 4, 4, 9, 10, 11, 2**40]
    with open(tmp_path / "f", "wb") as out:
        writer = packed.Writer(out, bits, block=1000)
        for i, d in zip(ids, docs):
            writer.add([i], np.array([len(d)]), d)
        writer.close()
    reader = packed.Reader(str(tmp_path / "f"))
    assert reader.ids == ids and reader.bits == bits
    for k, d in enumerate(docs):
        assert (reader.document(k) == d).all()
    whole = np.concatenate(docs)
    for a, b in ((0, 0), (999, 1001), (3, 17_011), (16_000, 16_001)):
        assert (reader.read(a, b) == whole[a:b]).all()
    with pytest.raises(ValueError):
        packed.Writer(open(tmp_path / "g", "wb"), 2).add([1], np.array([1]), np.array([4]))


def test_packed_documents_equal_the_library(spark):
    own = texts(6, 800)
    rows = [(None if k % 50 == 7 else k // 2, t if k % 31 else None) for k, t in enumerate(own)]
    random.Random(1).shuffle(rows)
    got = packed.packed(awkward(table(spark, rows))).orderBy("start").collect()
    want = {}
    for i, t in rows:
        ids = [*ids_of("word_bpe_49k.json", t or ""), 1]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    seen, start = {}, 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    assert packed.packed(table(spark, [])).count() == 0


def test_null_texts(spark):
    docs = table(spark, [(1, None), (None, ""), (3, "a"), (3, "a")])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.counts(docs).collect()) == [
        ("1", 0, 0), ("3", 1, 1), ("3", 1, 1), ("None", 0, 0)]
    empty = hashlib.sha256(b"").hexdigest()
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256 == empty) for r in transducer.round_trip(docs).collect())
    assert got == [("1", 0, True), ("3", 1, False), ("3", 1, False), ("None", 0, True)]
    assert token_counts.counts(docs.limit(0)).count() == 0 and transducer.round_trip(docs.limit(0)).count() == 0


def test_pieces_share_the_objects_of_their_ids_and_the_store_is_bounded(monkeypatch):
    encoder = packed.Encoder(place(packed.TOKENIZER))
    monkeypatch.setattr(packed, "PIECES_KEPT", 50)
    encoder.chunks.most = 60
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}," for i in range(400)]
    texts = [" ".join(words[i : i + 20]).encode() for i in range(0, 400, 20)]
    sizes, ids = encoder.encode(texts, packed.END)
    again = [encoder.encode([t], packed.END) for t in texts]
    assert sizes.tolist() == [int(s[0]) for s, _ in again]
    assert ids.tolist() == [int(i) for _, v in again for i in v]
    assert len(encoder.pieces) <= 50 + 21 and len(encoder.chunks.codes) <= 60 + 20
    assert all(number is encoder.numbers[number] for piece in encoder.pieces.values() for number in piece)


def test_only_pieces_of_mixed_chunks_are_kept_beside_chunks():
    encoder = transducer.Encoder(place(transducer.TOKENIZER))
    text = "alone again, naturally"
    (ids,) = encoder.encode([text])
    assert ids.tolist() == ids_of(transducer.TOKENIZER, text)
    assert "alone" not in encoder.pieces and "\u0120again" in encoder.pieces and "," in encoder.pieces


def test_short_pieces_go_through_the_transducer_side_by_side(monkeypatch):
    encoder = transducer.Encoder(place(transducer.TOKENIZER))
    own = encoder.transducer
    monkeypatch.setattr(transducer, "ABREAST", 70)
    rng = random.Random(9)
    tokens = [own.text[t] for t in own.made]
    pieces = ["".join(rng.choices(tokens, k=rng.randrange(0, 6))) for _ in range(600)]
    pieces += ["".join(rng.choices("aeinrst", k=k)) for k in (63, 64, 65, 256, 257, 900)] + ["", "a" * 64, "-" * 300]
    want = [own.whole(p) for p in pieces]
    sizes, ids = own.blocks(pieces)
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    assert [x.tolist() for x in own.blocks([])] == [[], []]
    with pytest.raises(ValueError):
        own.blocks(["ab", "a b"])

    def refuse(piece):
        raise AssertionError(f"worked on alone: {piece!r}")

    monkeypatch.setattr(own, "whole", refuse)
    monkeypatch.setattr(encoder, "split", refuse)
    texts = ["the  caf\xe9's na\xefve words,\n12\xd8ɏ!? ", "", "x", "<|endoftext|>İŉ end"]
    assert [x.tolist() for x in encoder.encode(texts)] == [ids_of(transducer.TOKENIZER, t) for t in texts]


def test_latin_pieces_equal_the_library():
    encoder = transducer.Encoder(place(transducer.TOKENIZER))
    texts = [f"a{c}b {c} '{c}s 1{c}2  {c}\n{c}{c} !{c}?" for c in map(chr, range(0x260))]
    assert [x.tolist() for x in encoder.encode(texts)] == [ids_of(transducer.TOKENIZER, t) for t in texts]


def test_numbers_are_found_by_their_keys_alone():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**48, 5000))
    values = rng.permutation(len(keys))
    numbers = transducer.Numbers(keys, values)
    others = np.setdiff1d(rng.integers(0, 2**48, 5000), keys)
    assert (numbers(keys) == values).all() and (numbers(others) == -1).all()
    assert transducer.Numbers(keys[:0], values[:0])(keys).max() == -1


def test_pairs_with_one_slot_keep_their_own_answers(monkeypatch):
    monkeypatch.setattr(transducer, "PAIR_SLOTS", 3)
    own = transducer.Transducer(vocabulary(place(transducer.TOKENIZER)))
    rng = random.Random(6)
    tokens = list(own.made)[:600]
    a, b = (np.array(rng.choices(tokens, k=4000)) for _ in range(2))
    want = [own.follows(x, y) for x, y in zip(a.tolist(), b.tolist())]
    assert 0 < sum(want) < len(want)
    for _ in range(2):
        assert own.all_follow(a, b).tolist() == want
