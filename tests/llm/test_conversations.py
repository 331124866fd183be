import random

from recollate.llm.conversations import conversations, has_text, speaker_of

SCHEMA = "origin string, session_id string, message_key string, version long, instant long, line long, op string, speaker string, filled boolean, broken boolean"


def event(session, key, at, who, filled=True, version=0, line=0, op="create", broken=False):
    return ("o", session, key, version, at, line, op, who, filled, broken)


def brute(events):
    """Sessions by a plain walk."""
    last, pos = {}, {}
    for e in sorted(events, key=lambda e: (e[3], e[4] if e[4] is not None else -1)):
        if e[1] is not None:
            last[e[1], e[2]] = e
            at, line = pos.get((e[1], e[2]), (None, e[5]))
            pos[e[1], e[2]] = (min(x for x in (at, e[4]) if x is not None) if at is not None or e[4] is not None else None, min(line, e[5]))
    sessions = {}
    for (s, k), e in last.items():
        if e[6] != "delete":
            sessions.setdefault(s, []).append((*pos[s, k], k, e[7], e[8]))
    out = set()
    for s, messages in sessions.items():
        if any(m[0] is None or m[3] is None for m in messages):
            continue
        turns = sorted(m for m in messages if m[4])
        who = [m[3] for m in turns]
        if "user" not in who or "assistant" not in who or next(w for w in who if w != "system") != "user":
            continue
        waiting = fails = False
        for i, w in enumerate(who):
            if w == "user" and (i == 0 or who[i - 1] != "user"):
                fails |= waiting
                waiting = True
            elif w == "assistant":
                waiting = False
        if not (fails or waiting):
            out |= {("o", s, i, m[2], m[3]) for i, m in enumerate(turns)}
    return out


def test_random_sessions_against_a_walk(spark):
    rng = random.Random(8)
    events = []
    for s in range(120):
        for i in range(rng.randint(1, 9)):
            events.append(event(f"s{s}", f"m{s}-{i:02}", rng.randint(0, 12), rng.choice(["user", "assistant", "user", "assistant", "tool", "system", None if rng.random() < 0.1 else "user"]), rng.random() < 0.9))
    events += events[:30]
    # one session with a third of all rows runs over many segments
    events += [event("hot", f"h{i:05}", i, "user" if i % 2 == 0 else "assistant") for i in range(300)]
    events += [event(None, "x", 1, "user"), event("late", "a", None, "user")]
    got = {tuple(r) for r in conversations(spark.createDataFrame(events, SCHEMA)).collect()}
    assert got == brute(events) and sum(1 for r in got if r[1] == "hot") == 300


def test_versions_fold(spark):
    base = [event("s", "a", 1, "user"), event("s", "b", 2, "assistant"), event("s", "c", 3, "tool", version=0)]
    edited = [*base, event("s", "c", 9, "tool", version=1, op="delete"), event("s", "a", 8, "user", version=2)]
    got = sorted(tuple(r)[2:] for r in conversations(spark.createDataFrame(edited, SCHEMA)).collect())
    assert got == [(0, "a", "user"), (1, "b", "assistant")]
    broken = [*base, event("s", "d", 4, "user", broken=True)]
    assert conversations(spark.createDataFrame(broken, SCHEMA)).count() == 0
    assert conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_roles_and_blanks(spark):
    df = spark.createDataFrame([(" Human ", " \n"), ("BOT", "x"), ("developer", None), ("42", ""), (None, "​"), ("function", " a ")], "r string, t string")
    got = [tuple(r) for r in df.select(speaker_of(df.r), has_text(df.t)).collect()]
    assert got == [("user", False), ("assistant", True), ("system", False), (None, False), (None, True), ("tool", True)]
