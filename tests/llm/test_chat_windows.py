import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spotframe.llm import chat_windows as cw
from spotframe.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, window string, n long"
HARD = "\\### Assistant: </turn> ok"
ROWS = [(1, 0, "system", "be kind"), (1, 1, "user", HARD), (1, 2, "assistant", HARD + "\n</turn"), (1, 3, "user", "x" * 700),
        (1, 4, "assistant", "y" * 90), (1, 5, "user", None), (1, 6, "assistant", ""), (1, 7, "assistant", "last"),
        (2, None, None, "no turn"), (2, 1, "assistant", "\\0\\1\\2\\3"), (2, 1, "assistant", "\\0\\1\\2\\3"),
        (3, 0, "system", "alone"), (None, 0, "user", "nobody"), (None, 1, "assistant", "é" * 10), (4, 0, "a\nb", "role")] + \
       [(5, i, "assistant" if i % 2 else "user", f"turn {i} " * (i % 7)) for i in range(700)]


def frame(llm, rows):
    return llm.createDataFrame([(*r, "w", 1) for r in rows], SCHEMA)


def said(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted([(t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c])
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from("\\0123#</turn> \n"), max_size=20), min_size=1, max_size=30))
def test_escape_is_reversible(llm, texts):
    df = llm.createDataFrame([(t,) for t in texts], "t string")
    for role in (False, True):
        code = cw.escape(F.col("t"), role)
        for r in df.select("t", code.alias("e"), cw.unescape(code).alias("u")).collect():
            assert r.u == r.t and cw.END not in r.e and cw.HEAD not in r.e
            assert not role or "\n" not in r.e


def test_digests_read_back(llm):
    for budget, history in ((2048, 512), (480, 80), (40, 0)):
        formatted = cw.windows(frame(llm, ROWS), budget, history)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cw.digests(formatted).collect()}
        assert got == said(ROWS)
        assert {r.conv_id: r.formatted_chars for r in cw.digests(formatted).collect()} == \
            {r.conv_id: r.n for r in formatted.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()}


def plain_windows(turns, budget, history):
    """(first new position, positions in order) of every window, by a walk over (role, text) turns."""
    costs = [len(f"### {r}\n{x}</turn>\n".encode()) for r, x in turns]
    lead = costs[0] if turns[0][0] == "system" else 0
    span = max(1, (budget - history - lead) // 2)
    before, bigs, groups = 0, 0, {}
    starts = []
    for i, c in enumerate(costs):
        starts.append(before)
        groups.setdefault((bigs, c > span, before // span), []).append(i)
        before += c
        bigs += c > span
    for new in groups.values():
        first = new[0]
        room = min(history, span, budget - lead - sum(costs[i] for i in new))
        again = [i for i in range(first) if (i == 0 and lead) or starts[first] - starts[i] <= room]
        yield first, again + new, sum(costs[i] for i in again + new), len(again)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), st.integers(0, 400)), min_size=1, max_size=30),
                min_size=1, max_size=8),
       st.integers(60, 900), st.integers(0, 50))
def test_windows_keep_any_budget(llm, conversations, budget, history):
    said = [[(r, "é" * (n // 3) + "w" * (n - n // 3)) for r, n in c] for c in conversations]
    rows = [(k, i, r, x) for k, c in enumerate(said) for i, (r, x) in enumerate(c)]
    got = {}
    for w in cw.windows(frame(llm, rows), budget, history).collect():
        got[w.conv_id, w.window_start] = (w.n_tokens, w.repeated)
        assert w.n_tokens == len(w.text.encode()) and w.over_budget == (w.n_tokens > budget)
        if w.over_budget:                         # one turn, and the system turn at most
            first = said[w.conv_id][0][0] == "system"
            assert w.text.count(cw.END) - w.repeated == 1 and w.repeated == (first and w.window_start > 0)
        if said[w.conv_id][0][0] == "system":
            assert w.text.startswith("### system\n" + said[w.conv_id][0][1] + cw.END)
    want = {(k, first): (n, again) for k, c in enumerate(said) for first, _, n, again in plain_windows(c, budget, history)}
    assert got == want


def test_history_is_repeated_and_masked(llm):
    windows = {(r.conv_id, r.window_start): r for r in cw.windows(frame(llm, ROWS), 800, 120).collect()}
    assert max(windows[5, s].repeated for c, s in windows if c == 5) > 0
    assert sum(r.window_start > 0 and r.text.startswith("### system\nbe kind") for (c, _), r in windows.items() if c == 1) >= 2


def test_a_cost_of_the_callers_own(llm):
    few = cw.windows(frame(llm, ROWS), 800, 120, lambda piece: F.ceil(F.length(piece) / 4))
    assert few.count() < cw.windows(frame(llm, ROWS), 800, 120).count()
    assert {r.conv_id: r.turns_sha256 for r in cw.digests(few).collect()} == {c: v[1] for c, v in said(ROWS).items()}


def test_no_byte_vocabulary_makes_more_tokens(llm):
    from tokenizers import Tokenizer

    from spotframe.llm.queries import public_tokenizers
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [x or "" for *_, x in ROWS] + ["   \n\t zqxj 日本語 \U0001f600\u0301", "{}" * 40]
    bounds = llm.createDataFrame([(t,) for t in texts], "t string").select("t", cw.token_bound(F.col("t")).alias("n")).collect()
    assert all(len(library.encode(r.t, add_special_tokens=False).ids) <= r.n for r in bounds)


def test_empty_and_query(llm, tables):
    assert cw.digests(cw.windows(frame(llm, []))).count() == 0
    got = queries.op9_chat_windows(llm, tables(conversations=frame(llm, ROWS)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    want = said(ROWS + [(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)])
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got.collect()} == want
