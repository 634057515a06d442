import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

from cellframe.llm.prefix_trie import SpillingQueue, prefix_trie


def brute(rows, every=20, most=4):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            said = f"{len(r or '')}:{r or ''}{x or ''}"
            turns[c].append(((t is not None, t or 0), hashlib.sha256(said.encode()).hexdigest(), r or "", x or ""))
    own = {c: [v[2:] for v in sorted(rows)] for c, rows in turns.items()}
    nodes, ends, below = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % most
        whole = tuple(own.get(c - int(math.fmod(c, every)), [])[:h] + said[h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            nodes[whole[:d]].append(c)
    for s in nodes:
        if s:
            below[s[:-1]].append(s)
    totals, out = {}, {}
    for s in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        totals[s] = sum(totals[k][0] for k in below[s]) if below[s] else 1, (len(nodes[s]) - 1) * words + sum(totals[k][1] for k in below[s])
        members = hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()
        out[min(nodes[s]), len(s)] = (min(nodes[s[:-1]]) if s else None, len(nodes[s]), len(below[s]), *totals[s], members)
    return out


def check(frame, rows, **shards):
    got = prefix_trie(frame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, link string, part int"), **shards).collect()
    want = brute(rows)
    assert len(got) == len(want) and {tuple(r)[:2]: tuple(r)[2:] for r in got} == want


def test_rebuilt_conversations(frame):
    rows = [(c, t, "user", f"w{t % 3} x") for c in range(45) for t in range(c % 6)] + [(None, 0, "user", "lost"), (60, None, None, None), (60, None, None, None), (61, 1, "a", "")]
    check(frame, rows)


def test_many_shards_long_chains_and_spills(frame):
    rng = random.Random(4)
    for case in range(2):
        ids = [*range(-3, 60), None, 2000, 5001, 5002]
        rows = [(rng.choice(ids), rng.choice([None, *range(9)]), rng.choice(["u", "a", None]), rng.choice(["", "x", "x y", None, "z\t z z"])) for _ in range(400)]
        rows += [(7, i, "u", "x") for i in range(60)] + [(2000 + 7 * j, i, "u", "x") for j in range(30) for i in range(j)]
        check(frame, rows, block=4, ids=2, levels=2, limit=3)


def test_one_conversation_of_many_turns_and_many_copies(frame):
    rows = [(5, i, "u", f"t{i}" + " long" * (50_000 if i == 9 else 0)) for i in range(3000)] + [(c, 0, "s", "same prompt") for c in range(100, 9000)]
    check(frame, rows)


def test_empty(frame):
    assert prefix_trie(frame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_queue_gives_back_what_it_spilled():
    rng = random.Random(1)
    queue, want = SpillingQueue(limit=5), defaultdict(list)
    for i in range(200):
        key = rng.randint(-5, 0), rng.randint(0, 9)
        want[key].append((i, -i))
        queue.push((*key, i, -i))
    for key in sorted(want):
        assert sorted(queue.pop(key)) == want[key]
    assert not queue.heap and not queue.runs and all(f.closed for f in queue.files)
