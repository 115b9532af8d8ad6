import random
from collections import defaultdict
from itertools import product

import pytest

from lakeworks.llm import chat as X
from lakeworks.llm import queries

from .fixtures import texts_of


def cheapest(roles):
    """Least cost by trying everything: each turn begins a message of any role or merges, empties in between."""
    best = [10**9]

    def closes(state):
        return {"": 0, "user": X.INSERT, "assistant": 0, "system": 2 * X.INSERT}[state]

    follows = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

    def price(role, new):
        return 0 if role == new else X.RELABEL if role in X.ROLES else X.RELABEL_UNKNOWN

    def go(i, state, cost):
        if cost >= best[0]:
            return
        if i == len(roles):
            best[0] = min(best[0], cost + closes(state))
            return
        if state:
            go(i + 1, state, cost + X.MERGE + price(roles[i], state))
        for new in follows[state]:
            go(i + 1, new, cost + price(roles[i], new))
            for after in follows[new]:
                go(i + 1, after, cost + X.INSERT + price(roles[i], after))

    go(0, "", 0)
    return best[0]


def replayed(rows):
    """Roles of the rendered messages, and the text of each."""
    text = "".join(r["piece"] for r in rows)
    assert text.startswith(X.BEGIN) and text.endswith(X.END)
    messages = [m.split("\n", 1) for m in text.removesuffix(X.END).removeprefix(X.BEGIN).split(X.END + X.BEGIN)]
    return [m[0] for m in messages], [m[1] for m in messages]


def check(rows, roles):
    rows = sorted(rows, key=lambda r: r["number"])
    assert [r["number"] for r in rows] == list(range(len(roles)))
    assert sum(r["cost"] for r in rows) == cheapest(roles)
    made, _ = replayed(rows)
    body = made[1:] if made[0] == "system" else made
    assert body == ["user", "assistant"] * (len(body) // 2) and len(body) % 2 == 0


def by_conversation(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["conv_id"]].append(r)
    return out


@pytest.mark.parametrize("chunk", [2, 3, 1024])
def test_random_roles_as_brute_force(spark, chunk):
    rng = random.Random(chunk)
    names = ["user", "assistant", "system", " User", "tool", None]
    convs = {i: [rng.choice(names) for _ in range(rng.randrange(1, 9))] for i in range(60)}
    convs[100] = ["system", "system", "assistant", "user"]
    rows = [(i, t, r, f"text {t}") for i, roles in convs.items() for t, r in enumerate(roles)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS number", "2 AS conv", "3 AS chunk", "4 AS part")
    got = by_conversation(X.repair(table, chunk).collect())
    assert set(got) == set(convs)
    for i, roles in convs.items():
        check(got[i], [r.strip().lower() if r else r for r in roles])


def test_chunks_do_not_change_the_result(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "x"]), f"t{t}") for t in range(700)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    cost = {c: sum(r["cost"] for r in X.repair(table, c).collect()) for c in (4, 1024)}
    assert cost[4] == cost[1024]


def test_matrices_as_options():
    for role, a, b in product(range(4), range(4), range(4)):
        costs = [o[0] for o in X._options(role) if o[2:4] == (a, b)]
        assert X.COSTS[role, a, b] == min(costs, default=X.NONE)
        if costs:
            merged, put = X.CHOICE[role, a, b]
            assert (min(costs), merged, put) in {(o[0], o[4], o[5]) for o in X._options(role)}


def test_whole_table_is_legal(spark, sf):
    turns = sorted(texts_of(sf, "conversations", "conv_id, turn, role, text"))
    roles, texts = defaultdict(list), defaultdict(list)
    for i, _, r, t in turns:
        roles[i].append(r)
        texts[i].append(t)
    got = by_conversation(queries.QUERIES["op7_chat"](spark, sf).collect())
    assert set(got) == set(roles)
    for i in roles:
        check(got[i], roles[i])
        _, said = replayed(sorted(got[i], key=lambda r: r["number"]))
        assert "".join(said).replace(X.JOIN, "") == "".join(texts[i]).replace(X.JOIN, "")


def test_nulls_repeats_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, None, None, None), (None, 1, "user", "a"), (5, 1, "user", "a"), (5, 1, "user", "a"), (6, 0, "ASSISTANT ", None)]
    got = by_conversation(X.repair(spark.createDataFrame(rows, schema)).collect())
    assert {k: len(v) for k, v in got.items()} == {None: 2, 5: 2, 6: 1}
    check(got[5], ["user", "user"])
    check(got[6], ["assistant"])
    check(got[None], [None, "user"])
    assert X.repair(spark.createDataFrame([], schema)).collect() == []
