import hashlib
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from resona.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit) by trying all edits of each row, with up to two insertions before each and at the end."""
    best = None
    gaps = [("",), ("I",), ("II",)]
    for edits in product("DKR", repeat=len(rows)):
        if any(e != "D" and f in "bd" for e, (_, f) in zip(edits, rows)):
            continue
        for inserts in product(range(3), repeat=len(rows) + 1):
            audit = "".join(gaps[n][0] + e for n, e in zip(inserts, edits)) + "I" * inserts[-1]
            cost = sum({"D": 4, "K": 0, "R": 3}[e] + 3 * (e != "D" and f == "t") for e, (_, f) in zip(edits, rows))
            cost += 3 * sum(inserts)
            if best and (cost, audit) >= best:
                continue
            # what an insertion or a new role becomes is free: try all
            kept = iter([r for e, (r, _) in zip(edits, rows) if e == "K"])
            options = [next(kept) if e == "K" else "ua" for e in audit if e != "D"]
            if any(GRAMMAR.fullmatch("".join(x)) and all(len(i) == 1 for i in x) for x in product(*options)):
                best = (cost, audit)
    return best


ROW = st.tuples(st.sampled_from(["u", "a", "s", "t", ""]), st.sampled_from("--tbd"))


@settings(max_examples=150, deadline=None)
@given(st.lists(ROW, max_size=4))
def test_search_equals_trying_all_edits(rows):
    assert C.search(rows) == cheapest(rows)


def by_states(rows):
    """The same for many rows: least (cost, audit) for each role state after each row."""
    best = {C.START: (0, "")}

    def inserted(best):
        for _ in range(3):
            for q, (c, a) in list(best.items()):
                to = C.USER if q != C.USER else C.ASSISTANT
                best[to] = min(best.get(to, (1 << 50, "")), (c + 3, a + "I"))
        return best

    for initial, fault in rows:
        new = {}

        def put(q, value):
            new[q] = min(new.get(q, (1 << 50, "")), value)

        for q, (c, a) in inserted(dict(best)).items():
            put(q, (c + 4, a + "D"))
            if fault not in "bd":
                extra = 3 * (fault == "t")
                put(C.USER if q != C.USER else C.ASSISTANT, (c + 3 + extra, a + "R"))
                if (initial == "u" and q != C.USER) or (initial == "a" and q == C.USER):
                    put(C.USER if initial == "u" else C.ASSISTANT, (c + extra, a + "K"))
                if initial == "s" and q == C.START:
                    put(C.SYSTEM, (c + extra, a + "K"))
        best = new
    best = inserted(dict(best))
    return min(best[q] for q in (C.START, C.ASSISTANT) if q in best)


@settings(max_examples=100, deadline=None)
@given(st.lists(ROW, max_size=120))
def test_search_equals_least_by_states_for_many_rows(rows):
    assert C.search(rows) == by_states(rows)


def test_bounds_never_exceed_what_the_rows_left_cost():
    rows = [("u", "-"), ("u", "t"), ("a", "b"), ("s", "-"), ("a", "-")]
    for i, bounds in enumerate(C.lower_bounds(rows, None)):
        for state in C.STATES:
            assert bounds[state] <= C.search(rows[i:], state)[0]


def test_long_conversations_are_proved_fast():
    import random
    import time

    random.seed(3)
    rows = [(random.choice("uas"), random.choice("--tbd")) for _ in range(C.BLOCK_ROWS)]
    began = time.perf_counter()
    assert C.search(rows) == by_states(rows)
    assert time.perf_counter() - began < 5


def expected(rows):
    """The contract by plain Python: conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        convs[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in own if t is not None]
        codes, seen = [], set()
        for _, role, text in own:
            kept = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not kept else "d" if (role, text) in seen else "t" if kept[-1] not in ".!?" else "-"
            seen.add((role, text))
            codes.append((role[:1], fault))
        cost, audit = by_states(codes)
        roles, texts, _ = C.applied([r for _, r, _ in own], [t for _, _, t in own], audit)
        assert GRAMMAR.fullmatch("".join(r[0] for r in roles))
        lines = "\n".join(f"{r}:{t}" for r, t in zip(roles, texts))
        initials = [c for c, _ in codes]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == x for _, f in codes) for x in "bdt"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256(lines.encode()).hexdigest(),
        )
    return out


def same(frame, rows):
    got = frame.collect()
    assert len(got) == len({r["conv_id"] for r in got})
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == expected(rows)


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."),
    (None, 1, "user", "No id."), (None, None, "assistant", "No turn!"), (None, None, None, None),
    (2, None, None, None), (3, 5, "user", ""), (3, 9, "user", "\t \n"), (3, 9, "user", " "),
    (4, 1, "tool", "Called."), (4, 2, "", "No role."), (4, 3, "assistant", "no end"), (4, 3, "assistant", "no end"),
    (5, -4, "user", "a" * 5000 + "."), (5, 7, "assistant", "é🙂."), (6, 1, "user", "One."), (6, 3, "system", "Two."),
    (7, 1, "Assistant", "Upper."), (8, 1, "s", "S."), (8, 2, "unknown", "U."), (8, 3, "a", "A."),
]


@pytest.mark.parametrize("block_rows", [1, 2, 3, 2000])
def test_odd_rows_in_blocks_of_any_size(spark, block_rows):
    rows = ODD + [(i, t, ["user", "assistant", "system"][(t * i) % 3], f"{t % 3} text{'.' * (t % 2)}")
                  for i in range(20, 40) for t in range(i % 13)]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", block string, cost int")
    same(C.digests(C.repair(C.damage(frame), block_rows=block_rows)), rows)


def test_conversation_with_a_third_of_all_rows_and_many_copies(spark):
    rows = [(9, t // 3, "user" if t % 2 else "assistant", f"Text {t % 40}{'.' * (t % 3)}") for t in range(700)]
    rows += [(9, 1, "user", "Copy.")] * 300 + [(i, t, "user", "Short.") for i in range(100, 600) for t in range(2)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    same(C.digests(C.repair(C.damage(frame), block_rows=50)), rows)
    same(C.digests(C.repair(C.damage(frame), block_chars=300)), rows)


def test_repaired_turns_are_the_texts(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "Again."), (1, 3, "assistant", "Yes.")]
    got = C.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("block").collect()
    cost, audit = C.search([("u", "-"), ("u", "-"), ("a", "-")])
    assert (sum(r["cost"] for r in got), "".join(r["audit"] for r in got)) == (cost, audit) == (3, "KIKK")
    assert [x for r in got for x in r["roles"]] == ["user", "assistant", "user", "assistant"]
    assert [x for r in got for x in r["texts"]] == ["Hi.", "", "Again.", "Yes."]


def test_empty_table(spark):
    assert C.digests(C.repair(C.damage(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_query_equals_brute_force(spark, base):
    rows = [tuple(r) for r in spark.read.parquet(f"{base}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = C.op11(spark, base)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert set(dict(got.dtypes)[c] for c in got.columns[1:7]) == {"bigint"}
    same(got, rows)
