import hashlib
import heapq
import random
import re
import zlib

from stayline.llm import conversations as C
from stayline.llm.common import small_batches

SCHEMA = "conv_id long, turn long, role string, text string, key int, audit string"


def spaced(value):
    return " " if value is None else str(value)


def after_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        out.setdefault(conv, []).extend([(turn, role, text)] * (2 if draw == 3 else 1))
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_edits(rows, found):
    """The cheapest edits by trying them all in order of cost, then of initials."""
    todo = [(0, "", 0, "", ())]
    while True:
        cost, audit, i, state, out = heapq.heappop(todo)  # state: role initials that matter: last, '' at first
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        follow = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[follow]
        if len(out) < 2 * len(rows) + 3:
            heapq.heappush(todo, (cost + 2, audit + "I", i, follow, (*out, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(todo, (cost + 3, audit + "D", i + 1, state, out))
            if found[i] not in ("blank", "duplicate"):
                left = found[i] == "truncated"
                initial = role[:1]
                if initial == follow or initial == "s" and state == "":
                    heapq.heappush(todo, (cost + left, audit + "K", i + 1, initial, (*out, f"{role}:{text}")))
                heapq.heappush(todo, (cost + 2 + left, audit + "R", i + 1, follow, (*out, f"{name}:{text}")))


def plain(rows):
    left = after_damage(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        own = left.get(conv, [])
        found = faults(own)
        turns = {t for t, _, _ in own if t is not None}
        initials = [r[:1] for _, r, _ in own]
        cost, audit, lines = plain_edits(own, found)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def run(spark, rows, tmp_path):
    from stayline.llm.queries import op13_conversations

    spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    found = op13_conversations(spark, str(tmp_path)).collect()
    assert len(found) == len({r[0] for r in rows})
    return {r[0]: tuple(r)[1:] for r in found}


def test_random_conversations(spark, tmp_path):
    rng, rows = random.Random(4), []
    texts = ["Yes.", "No!", "why", "Because?  \n", "", " \t", "a. b", "é…", None]
    for conv in [None, *range(60)]:
        for turn in rng.sample([None, *range(9)], rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "University"])
            rows += [(conv, turn, role, rng.choice(texts))] * rng.choice([1, 1, 1, 2])
    small_batches(spark, 5)
    assert run(spark, rows, tmp_path) == plain(rows)


def test_ties_inside_a_turn_and_an_empty_table(spark, tmp_path):
    rows = [(3, None, role, text) for role in ("user", "assistant") for text in ("Yes.", "No.", "Yes.", "cut")]
    assert run(spark, rows, tmp_path / "ties") == plain(rows)
    assert run(spark, [], tmp_path / "none") == {}


def test_long_runs_against_row_by_row():
    rng = random.Random(9)
    for _ in range(300):
        runs = [(rng.randrange(16), rng.choice([1, 2, 3, 5, 200, 1000])) for _ in range(rng.randint(1, 6))]
        costs = [C.LAST]
        rows = [s for s, n in runs for _ in range(n)]
        for symbol in reversed(rows):
            costs.append(C._applied(C._power(symbol, 0), costs[-1]))
        total, state, audit = costs.pop()[0], 0, ""
        for symbol in rows:
            edits, state = C._row_edits(symbol, state, costs.pop())
            audit += edits
        audit += {0: "", 1: "II", 2: "I", 3: ""}[state]
        assert C.cheapest(runs) == (total, audit)


def test_a_conversation_with_most_rows_is_cut_over_tasks(spark, tmp_path):
    rows = [(7, t, "user" if t % 2 else "assistant", f"text {t}.") for t in range(20_000)]
    rows += [(c, t, "user", "Hi.") for c in range(40) for t in range(3) if c != 7]
    damaged = C.damaged(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))
    found = C.symbols(damaged)
    pieces = found.repartitionByRange(8, *C.PLACE, "repeat").sortWithinPartitions(*C.PLACE, "repeat")
    pieces = pieces.select("key", "symbol", "n").mapInArrow(C._pieces, C.RUNS).filter("key = '7'").collect()
    assert len({r.piece for r in pieces}) >= 5
    # every edit of a long conversation: replay the audit over the rows
    result = run(spark, rows, tmp_path)[7]
    own = after_damage(rows)[7]
    marks, state, lines, cost, at = faults(own), "", [], 0, 0
    for edit in result[6]:
        follow = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[follow]
        if edit == "I":
            cost, state = cost + 2, follow
            lines.append(f"{name}:")
            continue
        (_, role, text), mark = own[at], marks[at]
        at += 1
        if edit == "D":
            cost += 3
            continue
        assert mark in ("", "truncated")
        role = role if edit == "K" else name
        cost, state = cost + (edit == "R") * 2 + (mark == "truncated"), role[0]
        lines.append(f"{role}:{text}")
    assert at == len(own) and state == "a" and cost == result[5]
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == result[7]


def test_query_on_the_given_table(spark, folder):
    from stayline.llm.queries import op13_conversations

    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in op13_conversations(spark, folder).collect()} == plain(rows)
