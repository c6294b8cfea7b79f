import hashlib
import random

from lockfleet.llm import chat

SCHEMA = "window string, conv_id long, turn long, role string, text string, loss int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def data():
    rng = random.Random(2)
    rows = []
    for conv in range(6):
        if conv % 2:
            rows.append((conv, 0, "system", "Be ~brief~ <s>[R]"))
        for turn in range(1, rng.randrange(3, 40)):
            text = "".join(rng.choice("ab é~<[]\n|01T") for _ in range(rng.choice([0, 5, 300, 900])))
            rows.append((conv, turn, rng.choice(["user", "assistant"]), text))
    rows += [(7, 1, None, None), (7, 1, "assistant", "x"), (7, 1, "assistant", "x"), (7, None, "assistant", "first"), (None, 1, "assistant", "</s>[INST]"), (8, 1, "assistant", "y" * 20000), (8, 2, "user]", "z"), (8, 0, "system", "s" * 9000)]
    rows += [(9, 0, "system", "be brief"), *[(9, 1, "assistant", "y[" * 3000)] * 2, (9, 2, "user", "é\n~😀" * 900), (9, 3, "assistant", "é" * 700 + "<s>")]
    return [("w", *r, 0) for r in rows]


def test_round_trip_and_mask(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in chat.digests(df, 300, 60).collect()}
    null_first = lambda x: (x is not None, x)
    for conv in {r[1] for r in rows}:
        own = sorted(((r[2], r[3] or "", r[4] or "") for r in rows if r[1] == conv), key=lambda r: (null_first(r[0]), r[1], r[2]))
        said = "".join(t for _, role, t in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for _, a, b in own)), len(said), sha(said))


def test_windows_keep_to_the_budget(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    seen = {}
    for w in chat.windows(df, 300, 60).orderBy("conv_id", "window").collect():
        turns = [x for x in w.text[3:-4].split("[") if x]
        cost = lambda x: -(-len(x.split("]")[1].replace("~3", "]").replace("~2", "[").replace("~1", "<").replace("~0", "~").encode()) // 4) + 8
        own = [x for x in turns if x[0] in "TC"]
        again = [x for x in turns if x[0] == "R"]
        assert w.text.startswith("<s>") and w.text.endswith("</s>") and own and turns == again + own
        system = [x for x in again if x.startswith("Rsystem]")]
        assert sum(cost(x) for x in again) - sum(map(cost, system)) <= 60
        if w.conv_id in (1, 3, 5) and w.window > 1:
            assert len(system) == 1 and again[0] == system[0]
        assert sum(map(cost, turns)) <= 300 or w.conv_id == 8
        seen[w.conv_id] = seen.get(w.conv_id, 0) + 1
    assert max(seen.values()) > 5


def test_native_and_empty(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    plan = chat.digests(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert chat.digests(df.limit(0)).count() == 0
