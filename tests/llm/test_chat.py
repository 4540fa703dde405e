import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from itemspark.llm import chat

pieces = st.lists(st.sampled_from(["[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[SAYS]", "[/ROLE]", "\\", "[", "<", "/", "s>",
                                   "INST]", "\n", "é", "a", "probe"]), max_size=8).map("".join)
turns = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[INST]", "\\"]), pieces), max_size=5)


@settings(max_examples=300, deadline=None)
@given(turns)
def test_output_reads_back(own):
    out, spans, loss, rewritten = chat.render_spans(own, chat.bracket_template, ("assistant",))
    assert rewritten == [] and chat.read_turns(out) == own
    assert [out[a:b] for a, b in spans] == [chat.bracket_template([t]) for t in own]
    assert [chat.unescape(out[a:b]) for a, b in loss] == [text for role, text in own if role == "assistant"]


@given(pieces)
def test_escape_leaves_no_control_string(text):
    import re
    assert not re.search(chat.CONTROL, chat.escape(text)) and chat.unescape(chat.escape(text)) == text


def test_templates_that_rewrite_history():
    def only_last_system(own):
        return "".join(f"<{r}>{t}" for i, (r, t) in enumerate(own) if r != "system" or i == len(own) - 1)

    def counted(own):
        return f"{len(own)}:" + "".join(t for _, t in own)

    told = [("system", "a"), ("user", "b"), ("assistant", "c")]
    assert chat.render_spans(told, only_last_system, ("assistant",))[1:] == ([], [], [1])
    assert chat.render_spans(told, counted, ("assistant",))[3] == [0, 1, 2]


def test_templates_that_change_texts():
    trimmed = lambda own: "".join(f"|{t.strip()}|" for _, t in own)
    out, spans, loss, _ = chat.render_spans([("user", " a "), ("assistant", " b ")], trimmed, ("assistant",))
    assert (out, spans, loss) == ("|a||b|", [(0, 3), (3, 6)], [(4, 5)])
    dropped = lambda own: "#" * len(own)
    assert chat.render_spans([("assistant", "x")], dropped, ("assistant",))[2] == [(0, 1)]


def test_nulls_ties_order_and_empty_table(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (None, None, None, "x", 0), (1, 1, "assistant", "b", 0),
            (2, 0, "user", "y" * 100_000, 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(table)).collect()}
    assert {c: (r["n_turns"], r["loss_chars"]) for c, r in got.items()} == {1: (3, 2), None: (1, 0), 2: (1, 0)}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(b"bb").hexdigest()
    assert chat.format_chats(table.limit(0)).count() == 0
