from tidegauge.llm.quotations import as_mail, conversations


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "m", 1) for r in rows], "conv_id long, turn long, role string, text string, message string, depth int")
    return conversations(frame).collect()


def test_nested_quotes_build_a_thread(spark):
    rows = [(1, 0, "a", "First question\nover two lines"), (1, 5, "b", "> First   QUESTION\n> over two lines\n\nAn answer."),
            (1, 3, "c", "Another one."), (1, 9, "a", "Thanks\n\n> An answer.\n\n> > First question over\n> > two lines\n\nbye"),
            (1, 7, "d", ">> First question over two lines\n> unknown words\nlate")]
    got = {r.turn: r for r in run(spark, rows)}
    assert {t: (r.root_turn, r.parent_turn, r.depth, r.levels) for t, r in got.items()} == {
        0: (0, None, 0, 0), 5: (0, 0, 1, 1), 3: (3, None, 0, 0), 9: (0, 5, 2, 2), 7: (0, 0, 1, 2)}
    assert got[9].text == "Thanks\n\nbye" and got[5].text == "An answer." and got[7].text == "late"
    assert [r.turn for r in sorted((r for r in got.values() if r.root_turn == 0), key=lambda r: r.position)] == [0, 5, 7, 9]
    assert sorted(r.position for r in got.values() if r.root_turn == 0) == [0, 1, 2, 3]


def test_defined_cases(spark):
    rows = [(1, 0, "a", None), (1, 1, "b", ""), (1, 2, "b", "> "), (1, 2, "b", "> "), (None, 0, "a", "x"), (None, 1, "b", "> x"), (2, None, None, "y"), (2, 4, "c", "> y"),
            (3, 0, "a", "> later"), (3, 1, "b", "later"), (4, 0, "a", "x"), (5, 0, "a", "ha"), (5, 1, "a", "ha"), (5, 2, "b", "> ha")]
    got = {(r.conv_id, r.turn): (r.parent_turn, r.depth) for r in run(spark, rows)}
    assert len(run(spark, rows)) == len(rows) - 1
    assert got[None, 1] == (0, 1) and got[2, 4] == (None, 1) and got[3, 0] == (None, 0) and got[1, 2] == (None, 0) and got[5, 2] == (0, 1)
    assert run(spark, rows[:0]) == []


def test_long_chains(spark):
    rows = [(1, i, "u", f"message {i}" + (f"\n\n> message {i - 1}" if i else "")) for i in range(70)]
    assert {(r.turn, r.depth, r.position, r.root_turn) for r in run(spark, rows)} == {(i, i, i, 0) for i in range(70)}


def test_mail_form_is_undone(spark):
    rows = [(c, t, "u", f"words {c} {t}\nmore") for c in range(3) for t in range(5)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.text, r.parent_turn) for r in conversations(as_mail(frame)).collect()}
    assert got == {(c, t): (x, t - 1 if t else None) for c, t, _, x in rows}
