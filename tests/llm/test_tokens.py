import random
import zlib

import numpy as np
import pytest

from cellframe.llm.packing import pack, plan_packs, with_crc
from cellframe.llm.token_files import TokenFile, encode_file, read_token_files, write_token_files
from cellframe.llm.tokens import PieceEncoder, encoder, vocabulary_path

TEXTS = ["", None, " ", "a  b", "don't  we'll.", "x<|endoftext|> y", "a\x1c b\x1cc", "\n\n a b\n c", "123 45.6 §§", "İ Σas ΑΣ", "Word word. WORD, word!!", "é Ab̈c", "lorem " * 3000]


@pytest.mark.parametrize("name,lead", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_give_the_ids_of_the_whole(name, lead):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(" \n\tab'sS1.\u00e9  \x1c\u0301 *|,") for _ in range(rng.randint(0, 14))) for _ in range(800)]
    coder = PieceEncoder(vocabulary_path(name), lead, limit=50)  # small: pieces are forgotten again and again
    for start in range(0, len(texts), 40):
        part = texts[start : start + 40]
        ids, sizes = coder.encode(part, 7)
        cut = np.split(ids, np.cumsum(sizes)[:-1])
        for text, own in zip(part, cut):
            assert own.tolist() == coder.tokenizer.encode(text or "", add_special_tokens=False).ids + [7], repr(text)


@pytest.mark.parametrize("name,lead", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens_are_matched(name, lead):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path(name))
    plain.no_padding()
    plain.no_truncation()
    texts = ["x<|endoftext|> y", "<|endoftext|>", "a <|ENDOFTEXT|>b", "a  <|endoftext|>  b\n<|startoftext|>é", "a <|end of text|>", *TEXTS]
    ids, sizes = PieceEncoder(vocabulary_path(name), lead).encode(texts, 7)
    for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert own.tolist() == plain.encode(text or "", add_special_tokens=False).ids + [7], repr(text)
    assert ids[: sizes[0]].tolist() == ([87, 50256, 331, 7] if lead else [343, 49407, 344, 7])


def test_files_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = rng.integers(0, 50_000, n).astype(np.uint32)
        ids[rng.random(n) < 0.8] %= 300
        if n:
            ids[n // 2] = 2**32 - 1
        sizes = np.array([n, 0], np.int64)
        file = TokenFile(encode_file(np.array([-5, 9]), sizes, ids))
        assert np.array_equal(file.decode_range(0, n), ids) and file.lengths.tolist() == [n, 0]
        for a, b in ((0, min(n, 3)), (n // 3, n), (n, n)):
            assert np.array_equal(file.decode_range(a, b), ids[a:b])


def _expected(name, lead, end):
    coder = PieceEncoder(vocabulary_path(name), lead)
    return {i: coder.tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for i, t in enumerate(TEXTS)}


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_of_a_table(frame):
    want = _expected("word_bpe_49k.json", False, 1)
    rows = read_token_files(write_token_files(frame(list(enumerate(TEXTS)) + [(None, "b")], "doc_id long, text string"), file_ids=50)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(TEXTS) + 1 and None in got
    at = got[None].n_tokens
    for i in sorted(want):
        assert (got[i].n_tokens, got[i].ids_crc32, got[i].start) == (len(want[i]), _crc(want[i]), at)
        at += len(want[i])


def test_packs_are_full_and_cover_every_item():
    rng = random.Random(2)
    for _ in range(30):
        cap = rng.choice([8, 64, 1024])
        hist = {n: rng.randint(1, 40) for n in rng.sample(range(1, cap), min(cap - 1, rng.randint(1, 60)))}
        used, items = {}, {}
        for length, lo, hi, inner, size, first, offset in plan_packs(hist, cap):
            for k in range(hi - lo):
                used.setdefault(first + k, []).append((offset, size))
                items.setdefault((length, lo + k), []).append((inner, size))
        assert len(items) == sum(hist.values())
        for (length, _), parts in items.items():
            assert sum(s for _, s in parts) == length
        full = 0
        for parts in used.values():
            at = 0
            for offset, size in sorted(parts):
                assert offset == at
                at += size
            assert at <= cap
            full += at
        assert len(used) == -(-full // cap)


def test_pieces_of_a_table(frame):
    docs = list(enumerate(TEXTS)) + [(3, TEXTS[3])] * 2
    want = _expected("byte_bpe_50k.json", True, 0)
    rows = with_crc(pack(frame(docs, "doc_id long, text string"))).collect()
    assert sum(r.length for r in rows) == sum(len(want[i]) for i, _ in docs)
    seq = {}
    for r in rows:
        assert r.ids_crc32 == _crc(want[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(want[r.doc_id])
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_tables(frame):
    empty = frame([], "doc_id long, text string")
    assert pack(empty).count() == 0 and read_token_files(write_token_files(empty)).count() == 0


def test_pieces_met_again_are_found(monkeypatch):
    rng = random.Random(3)
    pieces = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) + rng.choice(["", ",", "."]) for _ in range(260_000)]
    coder = PieceEncoder(vocabulary_path("byte_bpe_50k.json"), True)
    first = [coder.encode([" ".join(pieces[a : a + 50_000])], 0)[0] for a in range(0, len(pieces), 50_000)]
    monkeypatch.setattr(coder, "_code", lambda fresh: pytest.fail(f"{len(fresh)} pieces are coded again"))
    assert all((coder.encode([" ".join(pieces[a : a + 50_000])], 0)[0] == ids).all() for a, ids in zip(range(0, len(pieces), 50_000), first))


def test_a_piece_is_looked_up_once_a_call(monkeypatch):
    coder = PieceEncoder(vocabulary_path("byte_bpe_50k.json"), True)
    asked = []
    monkeypatch.setattr(coder, "_numbers", lambda parts, *times, own=coder._numbers: asked.extend(parts) or own(parts, *times))
    texts = ["the cat and the dog", None, "the cat\u00a0 and\u3000 the \u2003 dog\u00e9 \u0120 x " * 50]
    ids, sizes = coder.encode(texts * 20, 0)
    assert len(asked) == len(set(asked)) < 20
    for text, own in zip(texts * 20, np.split(ids, np.cumsum(sizes)[:-1])):
        assert own.tolist() == coder.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    for text in [" ", "  ", "a ", "\u3000 x", "\u00a0 ", "a  b", "\u00e9 a", "\U0001f600 a", "\u0420 a"]:  # the first bytes of a call
        assert coder.encode([text, None], 0)[0].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids + [0, 0]


@pytest.mark.parametrize("operator", ["signatures", "sets", "toxicity"])
def test_other_tasks_do_not_keep_the_encoders(operator):
    from cellframe.llm import near_text, toxicity

    kept = encoder(vocabulary_path("byte_bpe_50k.json"), True)
    kept.encode(["some words are kept"], 0)
    if operator == "signatures":
        tasks = near_text._signatures
    elif operator == "sets":
        tasks = near_text._set_rows(bytes(near_text.MARKS // 8))
    else:
        machine = toxicity.FactorizationMachine(np.ones(1, np.float32))
        tasks = toxicity._rejecter((np.zeros(1, np.uint32), machine, 0.0), 0.7)
    assert list(tasks(iter([]))) == [] and not encoder.cache_info().currsize
    assert encoder(vocabulary_path("byte_bpe_50k.json"), True).encode(["some words"], 0)[0].tolist() == kept.encode(["some words"], 0)[0].tolist()


def test_a_packing_task_gives_memory_back(monkeypatch):
    import os

    import pyarrow as pa
    import pyspark

    from cellframe.llm import packing

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: type("", (), {"partitionId": lambda self: 0})()))
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    encoder.cache_clear()
    path, given = vocabulary_path("byte_bpe_50k.json"), []
    monkeypatch.setattr(packing, "give_back", lambda: given.append(1))
    texts = ["some words in a text " * 1000] * 150
    made = list(packing._encode(path, 0, 1024)(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(150)), "text": texts})])))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"  # a task has one core
    assert len(given) == len(made) > 3 and max(b.num_rows for b in made) * len(texts[0]) <= 1_000_000
    assert [i for b in made for i in b.column("doc_id").to_pylist()] == list(range(150))


def test_sets_of_near_texts_are_made_in_slices(monkeypatch):
    import pyarrow as pa

    from cellframe.llm import near_text

    given = []
    monkeypatch.setattr(near_text, "give_back", lambda: given.append(1))
    texts = [f"the {i} words of one of many short texts" if i % 7 else None for i in range(2500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2500)), "text": texts, "mark": np.zeros(2500, np.int64)})
    made = list(near_text._set_rows(np.full(near_text.MARKS // 8, 255, np.uint8).tobytes())(iter([batch])))
    signed = list(near_text._signatures(iter([batch])))
    for out in (made, signed):
        assert [b.num_rows for b in out] == [1000, 1000, 500]
    assert len(given) == 2 and [i for b in signed for i in b.column("doc_id").to_pylist()] == list(range(2500))
    assert [n for b in signed for n in b.column("n_shingles").to_pylist()] == [len(near_text.shingle_set(t)) for t in texts]
