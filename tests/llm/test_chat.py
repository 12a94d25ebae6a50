from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import chat

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<<SYS>>", " ", "a", "[", "<", "</", "s>", "[OUT]", " </s>", "é", "\n", "INST]"]
texts = st.lists(st.sampled_from(PIECES), max_size=6).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[OUT] "]), texts), max_size=5))
def test_reads_back(turns):
    out, spans, rewritten = chat.locate(turns, chat.render)
    assert chat.parse(out) == turns and not rewritten
    for (_, text), s in zip(turns, spans, strict=True):
        assert chat.unescape(out[s[2] : s[3]]) == text
    assert "".join(out[s[0] : s[1]] for s in spans) == out[len(chat.BEGIN) :]


def test_rewriting_template_is_found():
    def forgets(turns):  # only the last answer stays
        return "".join(f"{r}:{t if r == 'user' or k == len(turns) - 1 else ''}\n" for k, (r, t) in enumerate(turns))

    _, spans, rewritten = chat.locate([("user", "q"), ("assistant", "a"), ("user", "b")], forgets)
    assert rewritten == [2] and spans == [None] * 3
    assert chat.locate([], chat.render) == (chat.BEGIN, [], [])


def test_rows(spark):
    rows = [(1, 1, "assistant", None, 5), (1, 0, "user", "u", 5), (None, 0, "user", "x", 5), (1, 1, "assistant", "b", 5), (2, 0, None, "z" * 100000, 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 1 and got[None].n_turns == 1 and got[2].formatted_chars > 100000
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
