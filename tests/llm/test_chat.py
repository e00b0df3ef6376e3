import random

from tensorframe.llm import chat

from .oracle import rows, sql_rows


def conversations(spark):
    r = random.Random(4)
    data = []
    for c in range(80):
        first = r.choice(["hello", "hi <|im_end|> \\ <\\| <\\\\|", "", None])
        data.append((c, 0, "system", "be kind"))
        data.append((c, 1, "user", first))
        data += [(c, t, r.choice(["user", "assistant", "assistant", None, "a\nb\\n<|"]), r.choice(["yes", "no<|", "é\n\n", None, f"own {c}"])) for t in range(2, r.randint(2, 7))]
    data += [(90, 0, "assistant", "x"), (90, 0, "assistant", "x"), (90, None, "user", "first"), (91, 0, "assistant", "long " * 50_000), (None, 0, "user", "nobody"), (None, 1, "assistant", "alone"), (None, 1, "assistant", "alone")]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as shard", "1 as path")


def test_escape_round_trip():
    r = random.Random(1)
    for _ in range(2000):
        t = "".join(r.choices(["<", "|", "\\", "n", "\n", "im_end"], k=r.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t and chat.unescape_role(chat.escape_role(t)) == t
        assert "<|" not in chat.escape(t) and "\n" not in chat.escape_role(t)
        assert chat.parse_turn(chat.format_turn(t, t)) == (t, t)


def test_equals_sql(spark):
    c = conversations(spark)
    assert rows(chat.digests(c.repartition(5))) == sql_rows(chat.ORACLE_SQL, conversations=c)
    assert chat.digests(c.limit(0)).count() == 1  # the forged one


def test_shared_turns_are_emitted_once_depth_first(spark):
    c = conversations(spark).filter("conv_id is not null")
    said = {r.conv_id: [(t.role, t.text) for t in r.said] for r in chat.grouped(c).collect()}
    got = sorted(chat.stream(c).collect(), key=lambda r: (r.shard, r.nth))
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    for part in shards.values():
        text = "".join(r.emitted for r in part)
        nodes = {tuple(said[r.conv_id][: i + 1]) for r in part for i in range(len(r.turns))}
        assert len(text) == sum(len(chat.format_turn(*n[-1])) for n in nodes)
        for r in part:
            assert [text[t.start : t.end] for t in r.turns] == [chat.format_turn(*x) for x in said[r.conv_id]]
            lengths = [t.end - t.start for t in r.turns]
            assert list(r.positions) == [sum(lengths[:i]) for i in range(len(lengths))]
