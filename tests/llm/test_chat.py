from gridmine.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, own long, h string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r, x))
    key = lambda v: tuple((x is not None, x) for x in v)
    whole = {c: tuple((r, x) for _, r, x in sorted(v, key=key)) for c, v in convs.items()}
    prefixes = {v[:k] for v in whole.values() for k in range(1, len(v))}
    out = {}
    for c, v in sorted(whole.items()):
        if v not in prefixes:
            out.setdefault(v, []).append(c)
    return sorted((ids[0], len(v), len(ids), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in v)) for v, ids in out.items())


def rows():
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "bye")]
    out = [(c, t, *talk[t]) for c in range(1, 5) for t in range(c)]
    out += [(9, t, *talk[t]) for t in range(4)]
    out += [(10, 0, "user", "hi"), (10, 1, "assistant", None), (11, 0, "user", "hi"), (11, 1, "assistant", "")]
    out += [(None, 0, "user", "lost"), (12, None, None, "x"), (12, 0, None, "x"), (13, 5, "user", "long " * 5000), (14, 0, "user", "hi"), (14, 0, "user", "hi")]
    out += [(15, 0, "user", "hi"), (15, 0, "assistant", "hello")]
    return out


def test_against_plain(spark):
    got = chat.chat_documents(frame(spark, rows()).repartition(3)).select("conv_id", "n_turns", "n_equal", "rendered").collect()
    assert sorted(map(tuple, got)) == plain(rows())


def test_empty(spark):
    assert chat.chat_documents(frame(spark, [])).collect() == []
