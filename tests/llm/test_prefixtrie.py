"""The prefix trie against a plain walk over all prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from rowloom.llm import prefixtrie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth int, size int, top string"


def frame(spark, rows):
    """Turns with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    out = {}
    for c in own:
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def plain(convs):
    member, below = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            member[tuple(turns[:d])].append(c)
    for node in member:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    kids = defaultdict(int)
    for node in member:
        if node:
            kids[node[:-1]] += 1
    words = {node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0 for node in member}
    out = []
    for node, held in member.items():
        ends = ",".join(str(c) for c in sorted(held) if len(convs[c]) == len(node))
        saved = sum((len(member[x]) - 1) * words[x] for x in below[node])
        leaves = sum(not kids[x] for x in below[node])
        parent = min(member[node[:-1]]) if node else None
        out.append((min(held), len(node), parent, len(held), kids[node], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, component=P.COMPONENT):
    turns = P.numbered(frame(spark, rows))
    convs = turns.select("conv").distinct()
    got = P.prefix_trie(convs, P.with_shared_starts(convs, turns), component).collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(4)
    out = []
    for conv in [*range(70), -1, -40, -41, 200, 10**12, 2**62]:
        for turn in range(pick.randrange(1, 9)):
            out.append((conv, turn, pick.choice(["user", "assistant"][turn % 2 :] + [None]), pick.choice(["a", "b b", "", None, "x\ny z"])))
    out += [(300, None, "u", "first"), (300, 5, "u", "b"), (300, 5, "u", "a"), (300, 5, "u", "a"), (300, -3, "u", None), (None, 1, "u", "lost")]
    out += [(340, i, "u", "long way") for i in range(60)] + [(341, i, "u", "long way") for i in range(40)] + [(360, i, "u", "long way") for i in range(60)]
    return out


@pytest.mark.parametrize("component, bucket", [(20_000, 4096), (12, 3), (1, 4096)])
def test_nodes_as_by_plain_walk(spark, rows, monkeypatch, component, bucket):
    monkeypatch.setattr(P, "BUCKET", bucket)
    assert run(spark, rows, component) == plain(rebuilt(rows))


def test_totals_in_memory():
    pick = random.Random(8)
    for shape in ("random", "chain", "star"):
        parent = [-1] + [{"random": pick.randrange(i), "chain": i - 1, "star": 0}[shape] for i in range(1, 300)] + [-1, 300]
        value = [pick.randrange(9) for _ in parent]
        size, want = [1] * len(parent), list(value)
        for i in range(len(parent) - 1, -1, -1):
            if parent[i] >= 0:
                size[parent[i]] += size[i]
                want[parent[i]] += want[i]
        assert P.rolled_up(list(zip(parent, size, value))) == [(w,) for w in want]


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 0, "u", "a")]) == []
    assert run(spark, [(21, 0, "u", "a")]) == plain(rebuilt([(21, 0, "u", "a")]))
