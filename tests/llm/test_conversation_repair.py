from __future__ import annotations

import hashlib
import random
import re
import zlib

from ledgerspark.llm import conversation_repair as C

GOOD = re.compile("(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"


def brute(symbols: str) -> tuple[int, str]:
    """The least (cost, audit) by the least of each (rows read, roles written), roles being prefixes of good ones."""
    n = len(symbols)
    outs = {""} | {lead + ("ua" * (n + 2))[:k] for lead in ("", "s") for k in range(0, 2 * n + 3)}
    best = {(0, ""): (0, "")}
    for i in range(n + 1):
        for out in sorted(outs, key=len):  # inserts lead to longer ones
            if (i, out) not in best:
                continue
            cost, audit = best[i, out]
            moves = [(i, out + r, 3, "I") for r in "ua"]
            if i < n:
                s = symbols[i]
                extra = 3 if s.isupper() else 0
                moves.append((i + 1, out, 4, "D"))
                if s != "x":
                    moves.append((i + 1, out + s.lower(), extra, "K"))
                    moves += [(i + 1, out + r, 3 + extra, "R") for r in "ua" if r != s.lower()]
            for j, to, price, letter in moves:
                if to in outs:
                    best[j, to] = min(best.get((j, to), (1 << 40, "")), (cost + price, audit + letter))
    return min(v for (i, out), v in best.items() if i == n and GOOD.fullmatch(out))


def test_cheapest_edits_equal_brute_force():
    rng = random.Random(2)
    cases = ["", "s", "S", "u", "U", "a", "A", "o", "O", "x", "su", "ss", "uu", "aa", "sua", "ssua", "xxxx"]
    cases += ["".join(rng.choice("suaauasUAoOx") for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    cases += [letter * n for letter in "suaUAS" for n in (5, 12, 15)]
    for case in cases:
        assert C.cheapest(case) == brute(case), case


def test_forms_do_not_grow_with_length():
    rng = random.Random(3)
    for letters in ("u", "ua", "us", "suaUASoOx"):
        C.cheapest("".join(rng.choice(letters) for _ in range(3000)))
    forms = len(C._frontier.forms)
    for letters in ("u", "ua", "us", "suaUASoOx"):
        C.cheapest("".join(rng.choice(letters) for _ in range(30000)))
    assert len(C._frontier.forms) <= forms * 1.5 + 50


def expected(rows: list[tuple], conversations: list) -> dict:
    """rows: conv_id, turn, role, text after damage."""
    out = {}
    for conv in conversations:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, symbols, counts = set(), "", dict.fromkeys("bdt-", 0)
        for _, _, role, text in mine:
            own = text.rstrip(SPACES)
            f = "b" if not own else "d" if (role, text) in seen else "t" if own[-1] not in ".!?" else "-"
            seen.add((role, text))
            counts[f] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if f in "bd" else letter.upper() if f == "t" else letter
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit = brute(symbols)
        length = len(audit) - audit.count("D")
        names = (["system"] if length % 2 else []) + ["user", "assistant"] * (length // 2)
        lines, k = [], 0
        for a in audit:
            if a == "I":
                lines.append(names[len(lines)] + ":")
                continue
            if a == "K":
                lines.append(mine[k][2] + ":" + mine[k][3])
            elif a == "R":
                lines.append(names[len(lines)] + ":" + mine[k][3])
            k += 1
        out[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def report(spark, rows: list[tuple], damaged: bool) -> dict:
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, pos int")
    return {r[0]: tuple(r)[1:] for r in C.repair_report(df, C.damaged(df) if damaged else df).collect()}


def odd_rows() -> list[tuple]:
    rng = random.Random(9)
    rows: list[tuple] = [(None, 1, "user", "A."), (None, None, None, None), (1, None, "user", "B"), (1, None, "user", "B"), (1, 3, "tool", "C!"), (1, 3, "", "C! \n"), (2, 5, "assistant", ""), (3, -(2**40), "system", "S." * 20000), (3, 2**40, "user", "é?\t")]
    for conv in range(10, 60):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), rng.choice(["One.", "Two", "Three!", " ", "Four?"])))
    return rows


def test_report_on_odd_rows(spark):
    rows = odd_rows()
    conversations = {r[0] for r in rows}
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert report(spark, rows, False) == expected(plain, conversations)
    assert report(spark, rows, True) == expected(damage(rows), conversations)
    assert report(spark, [(5, 0, "user", "x")], True).keys() == {5}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair_report(empty, C.damaged(empty)).count() == 0


def test_dropped_conversations_have_nothing(spark):
    conv = next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert report(spark, [(conv, 0, "user", "x.")], True) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_one_conversation_with_most_rows_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 8)
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["Yes.", f"No {t}.", f"Well {t}", ""])) for t in range(150)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")]
    assert report(spark, rows, False) == expected(rows, [1, 2])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    numbered = C.numbered(df)
    fixed = sorted(map(tuple, C.repaired(numbered, C.plans(numbered)).collect()))
    for conv in (1, 2):
        mine = [r for r in fixed if r[0] == conv]
        assert GOOD.fullmatch("".join(r[2][0] for r in mine)) and [r[1] for r in mine] == list(range(mine[0][1], mine[0][1] + len(mine)))
        assert hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in mine).encode()).hexdigest() == expected(rows, [conv])[conv][-1]


def test_query_on_given_conversations(spark):
    from ledgerspark.llm.queries import queries

    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries()["op13_conversation_repair"](spark, path).collect()}
    assert got == expected(damage(rows), {r[0] for r in rows})
