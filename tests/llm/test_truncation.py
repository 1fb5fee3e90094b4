from lumenquote.llm import truncation as T

CLOSED = 'Water runs.[1]{c1}\n\nEVI1\nc1|1|"Water runs down."\nEND_EVI1'


def test_answers(spark):
    texts = [
        CLOSED, CLOSED[:-1], CLOSED[:40], "A finished sentence.", "A finished question?", "It breaks off in the mid", "It breaks at a word of the", "Cited.[1]{c1}", "Cited.[1]{c", "", "  \n", None, "He said “done.”", "Die Pumpe (Nr.", "x" * 100_000,
    ]
    numbered = ["Die Pumpe Nr. 7 steht still. Der Kessel Nr. 12 lief."] * 5
    finished = [f"{'Some text here. ' * (i + 1)}\n\nSee https://handbook.example/guide/{i}" for i in range(40)]
    rows = [(i, "web" if i % 2 else None, t, "n") for i, t in enumerate(texts + finished + numbered)]
    a = spark.createDataFrame(rows + rows[:7], "answer_id bigint, channel string, answer string, reason string")
    got = {r.answer_id: r.reason for r in T.cut_answers(a).collect()}
    assert got == {1: "appendix", 2: "appendix", 5: "break", 6: "break", 8: "break", 13: "break", 14: "break"}
    assert T.cut_answers(a.limit(0)).count() == 0


NEVER = T.SpikeRule(least=10**9)


def lines(n):
    """Finished answers whose usual closing line is a link; answers cut at n characters, some of them inside such a link."""
    finished = [f"{'Some text here. ' * (i % 30 + 1)}\n\nSee https://handbook.example/guide/{i % 7}" for i in range(200)]
    cut = [(f"{i} words without an end " * 100)[:n] for i in range(30)]
    return finished, cut, [("Plain words. " * 100)[: n - 37] + f"\nSee https://handbook.example/guide/{i}" for i in range(10)]


def test_spikes(spark):
    rows = [(i, "kiosk" if i < 60 else "web", ("Word " * 400)[: 480 if i < 60 else 300 + 7 * i] + "z") for i in range(120)]
    a = spark.createDataFrame(rows, "answer_id bigint, channel string, answer string")
    got = {(r.answer_id, r.reason) for r in T.cut_answers(a).collect()}
    assert got == {(i, "limit" if i < 60 else "break") for i in range(120)}


def test_without_spikes_rows_are_lost(spark):
    """A closing line that is usual saves an answer, but not one at a spike: these are found by the spike alone."""
    finished, cut, in_link = lines(483)
    rows = [(i, "kiosk", x) for i, x in enumerate(finished + cut + in_link)]
    a = spark.createDataFrame(rows, "answer_id bigint, channel string, answer string")
    got = {(r.answer_id, r.reason) for r in T.cut_answers(a).collect()}
    assert got == {(i, "limit") for i in range(200, 240)}
    assert {(r.answer_id, r.reason) for r in T.cut_answers(a, NEVER).collect()} == {(i, "break") for i in range(200, 230)}


def test_spikes_in_bytes(spark):
    """A limit of 400 bytes stands at many lengths in characters."""
    rows = []
    for i in range(60):
        text = "é" * (3 * i % 97) + "Word " * 200
        cut = text.encode()[:400].decode("utf-8", "ignore")
        rows.append((i, "mail", cut + "x" * (400 - len(cut.encode()))))
    rows += [(100 + i, "mail", ("Word " * 200)[: 203 + 11 * i] + "z") for i in range(12)]
    values = spark.createDataFrame([(i, c, len(t), len(t.encode()), True) for i, c, t in rows], "id int, channel string, n int, b int, u boolean")
    assert {(r.unit, r.length, r.n) for r in T.length_spikes(values, "channel", "n", "b", "u").collect()} == {("bytes", 400, 60)}
    found = T.cut_answers(spark.createDataFrame(rows, "answer_id bigint, channel string, answer string")).filter("reason = 'limit'")
    assert {r.answer_id for r in found.collect()} == set(range(60))


def test_quotes_at_a_spike(spark):
    """Quotes of 60 characters whose source is not given: only the spike tells."""
    text = "The pump ran for many days and then it stood still for a week in the cold "
    e = spark.createDataFrame([(i, 1, 1, (text * 3)[i % 7 : i % 7 + 60 if i < 40 else 60 + 3 * i % 90].strip().ljust(60 if i < 40 else 0, "x")) for i in range(70)], "answer_id bigint, line_no int, source_index int, quote string")
    s = spark.createDataFrame([], "answer_id bigint, source_index int, text string, extra_texts array<string>")
    a = spark.createDataFrame([(i, "api", CLOSED) for i in range(70)], "answer_id bigint, channel string, answer string")
    assert {r.answer_id for r in T.cut_quotes(e, s, a).filter("reason = 'limit'").collect()} >= set(range(40))
    assert T.cut_quotes(e, s, a, NEVER).count() == 0


def test_abbreviations_are_learned(spark):
    a = spark.createDataFrame([("Nr. 7 is on. It ran.",)] * 9 + [("He left. Then he came. Or not. 7 men.",), (None,)], "answer string")
    assert T.abbreviations(a) == ["Nr"]


def test_quotes(spark):
    source = "The pump ran for days. Later, the old valve closed near Berlin. The boiler (Nr. 40) failed"
    quotes = ["The pump ran for days.", "The pump ran for days", "The pump ran for", "The pump ran for da", "ran for days", "Later, the old val…", "Later, the old valve...", "valve closed near Berlin ", "The boiler (Nr.", "(Nr. 40) failed", "invented text without an end", "", None, "  "]
    e = spark.createDataFrame([(1, i, 1, q, "x") for i, q in enumerate(quotes)] * 2 + [(2, 0, 1, "The pump ra", "x"), (3, 0, 1, "From an extra te", "x")], "answer_id bigint, line_no int, source_index int, quote string, channel string")
    s = spark.createDataFrame([(1, 1, source, None), (1, 1, source, None), (2, 1, None, None), (3, 1, "", ["x", None, "From an extra text."])], "answer_id bigint, source_index int, text string, extra_texts array<string>")
    a = spark.createDataFrame([(1, "web", "Nr. 1, Nr. 2, Nr. 3, Nr. 4, Nr. 5. " + CLOSED), (3, None, CLOSED)], "answer_id bigint, channel string, answer string")
    got = {(r.answer_id, r.line_no, r.channel) for r in T.cut_quotes(e, s, a).collect()}
    assert got == {(1, i, "web") for i in (2, 3, 5, 6, 8)} | {(3, 0, None)}
    rates = {(r.channel, r.field): (r.n_values, r.n_cut) for r in T.cut_rates(a, e, s).collect()}
    assert rates == {("web", "answer"): (1, 0), (None, "answer"): (1, 0), ("web", "quote"): (14, 5), (None, "quote"): (2, 1)}
    assert T.cut_quotes(e.limit(0), s, a).count() == 0
