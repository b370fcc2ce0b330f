import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from strideway.llm import chat

pieces = st.lists(st.sampled_from([*chat.CHATML.control, "\\", "<", "|im", "a", "é", "\n", "[", "/s>", "_end|>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(pieces, pieces)
def test_escape_is_reversible_and_hides_controls(role, text):
    e = chat.escape(text)
    assert chat.unescape(e) == text and not any(c in e for c in chat.CHATML.control)
    t = chat.CHATML
    assert chat.parse(t.start + chat.escape(role) + t.separator + e + t.end) == [(role, text)]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_query_against_brute_force(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (2, 1, "assistant", "b" * 100_000), (2, 0, "user", "é\\n"),
            (3, 0, "user", "x"), (3, 0, "user", "x"), (3, 0, "assistant", "tie"), (None, 0, None, "</s>"), (4, None, "tool", ""), (4, 0, "user", "z")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, segment int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(chat.with_probe(df))).collect()}
    by = {}
    for c, t, r, x in [*rows, (-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == sha(*(f"{r}\n{x}\n" for _, r, x in turns))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
    assert got[1]["bad_turn"] is None and got[2]["bad_turn"] is None
    assert got[3]["bad_turn"] == 0 and got[4]["bad_turn"] == 0 and got[None]["bad_turn"] == 0


def test_segments_are_the_string(spark):
    df = chat.with_probe(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    rows = sorted(chat.format_conversations(df).collect(), key=lambda r: r["seg_no"])
    text = "".join(r["segment"] for r in rows)
    assert chat.parse(text) == [("user", chat.PROBE), ("assistant", chat.PROBE)]
    assert [r["loss"] for r in rows] == [False, False, False, False, True, False]
    assert not any(c in r["segment"] for r in rows if r["kind"] == "text" for c in chat.CHATML.control)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(df)).count() == 0
