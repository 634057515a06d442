import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from cellframe.llm.alignment import Aligner, align_documents
from cellframe.llm.tokens import vocabulary_path

A_PATH, B_PATH = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
ODD = ["", None, " ", "a  b", " a", "a ", "  ", "don't  we'll.", "x<|endoftext|> y</s><s>", "a\x1c b\x1cc", "\n\n a b\n c", "123 45.6 §", "x▁y ▁ z", "é Ab̈c ﬁ \U0001d518 日本語"]
ODD += ["lorem " * 3000, "</s>", "\t", "a\x00b", "　 a  b", "  ​ x", "q" * 3000]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(shown)))}

    def spans(parts):
        at = 0
        for p in parts:
            yield at, at + len(p)
            at += len(p)

    def one(text):
        if not text:
            return None
        coded, ids = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        pieces = [b.id_to_piece(i) for i in ids]
        parts_a = [bytes(byte[c] for c in t) for t in coded.tokens]
        parts_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        if not b"".join(parts_a) == b"".join(parts_b) == b" " + text.encode():
            return None
        of_a, of_b = list(spans(parts_a)), list(spans(parts_b))
        stops = sorted({e for _, e in of_a} & {e for _, e in of_b})
        group_a, group_b, k = defaultdict(list), defaultdict(list), 0
        for out, spots, names in ((group_a, of_a, coded.ids), (group_b, of_b, ids)):
            k = 0
            for (_, e), i in zip(spots, names):
                while stops[k] < e:
                    k += 1
                out[k].append(str(i))
        groups = ";".join(f"{','.join(group_a[k])}|{','.join(group_b[k])}" for k in range(len(stops)))
        links, k = [], 0
        for (s, e), i in zip(of_a, coded.ids):
            while of_b[k][1] <= s:
                k += 1
            m = k
            while m < len(ids) and of_b[m][0] < e:
                links.append((i, ids[m]))
                m += 1
        return len(of_a), len(of_b), len(stops), links, hashlib.sha256(groups.encode()).hexdigest()

    return one


def brute(one, rows):
    made = {t: one(t) for t in {t for _, t in rows}}
    count, best = Counter(), defaultdict(int)
    for _, t in rows:
        if made[t]:
            count.update(set(made[t][3]))
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for d, t in rows:
        if made[t] is None:
            yield d, 0, 0, 0, 0, 0, 0, ""
        else:
            a, b, groups, links, digest = made[t]
            yield d, a, b, groups, len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), digest


def test_documents_against_whole_texts(frame, plain):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" \n\tab'sS1.é  \x1ć *|,<>") for _ in range(rng.randint(0, 14))) for _ in range(900)]
    rows = [*enumerate(texts), (None, "a b c"), (5, "a b c"), (5, "a b c"), (6, texts[9])]
    docs = frame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, pair string")
    want = Counter(brute(plain, rows))
    for run_links in (50, 3_000_000):
        assert Counter(map(tuple, align_documents(docs, run_links=run_links).collect())) == want


def test_pieces_are_forgotten_without_changing_results():
    texts = [t for t in ODD if t] * 3
    small, large = Aligner(A_PATH, B_PATH, limit=2), Aligner(A_PATH, B_PATH)
    for t in texts:
        a, b = small.measure([t]), large.measure([t])
        assert a[1] == b[1] and all((x == y).all() for x, y in zip((a[0], *a[2:]), (b[0], *b[2:])))


def test_a_full_cache_keeps_what_was_met_again(monkeypatch):
    rng = random.Random(4)
    common = ["".join(rng.choices("abcdefghij", k=8)) for _ in range(300)]
    coder, asked = Aligner(A_PATH, B_PATH, limit=1000), []
    monkeypatch.setattr(coder, "_aligned", lambda texts, own=coder._aligned: asked.append(texts) or own(texts))
    for k in range(12):
        coder.measure([" ".join(common * 2 + [f"once{k}x{i}" for i in range(400)])])
    assert len(coder.index) <= 1400 and sum(common[0] in texts for texts in asked) == 1


def test_what_a_task_holds_is_bounded(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from cellframe.llm import alignment

    monkeypatch.setattr(alignment.TaskContext, "get", staticmethod(lambda: type("", (), {"partitionId": lambda self: 0})()))
    coder, pieces, slices = Aligner(A_PATH, B_PATH), [], []
    monkeypatch.setattr(coder, "_aligned", lambda texts, own=coder._aligned: pieces.append(len(texts)) or own(texts))
    monkeypatch.setattr(coder, "measure", lambda texts, own=coder.measure: slices.append(sum(map(len, texts))) or own(texts))
    monkeypatch.setattr(alignment, "_aligner", lambda *paths: coder)
    texts = [" ".join(f"{i * 300 + k:x}z" for k in range(300)) for i in range(400)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "n": np.full(400, 2)})
    made = pa.Table.from_batches(alignment._align_texts(A_PATH, B_PATH, 3_000_000)(iter([batch])))
    assert max(pieces) <= 4096 and max(slices) <= 500_000 and made.num_rows == 401
    asked = made.filter(pa.compute.equal(made["kind"], alignment.ASKED))
    weights = Counter()
    for row in made.slice(0, 400)["pairs"].to_pylist():
        weights.update({p: 2 for p in row})
    assert dict(zip(asked["pairs"][0].as_py(), asked["weights"][0].as_py())) == weights


def test_empty(frame):
    assert align_documents(frame([], "doc_id long, text string")).collect() == []
    assert [tuple(r) for r in align_documents(frame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
