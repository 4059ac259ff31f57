"""Terms and quotations are found wherever they stand."""

from papertide.llm import pii, quotations


def test_telling_terms_far_from_entities(spark):
    far = "Quintessa said so. " + "filler words go on " * 10 + " write to Quintessa at q@corp.example soon"
    rows = [(1, far), (2, "Ask Quintessa or q@corp.example daily"), (3, "nobody knows QUINTESSA here"), (4, "Quintessas are others"), (5, None)]
    out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), bits=2.0).collect()}
    assert len(out) == len(rows)
    b = far.rindex("Quintessa")
    terms = [s for s in out[1].spans.split(",") if s.startswith("term")]
    assert terms == ["term:0:9", f"term:{b}:{b + 9}"] and out[1].n_term == 2
    assert out[3].spans == "term:13:22" and out[3].n_term == 1
    assert out[4].spans == "" and out[5].spans == ""


def test_quotes_of_some_lines(spark):
    body = "one a\ntwo b\n\nthree c\nfour d\nfive e"
    rows = [
        (1, 0, "u", body),
        (1, 1, "u", "> two B\n> three c\nyes"),
        (1, 2, "u", "> one a\n> three c\nno"),
        (1, 3, "u", "> yes\nfirst\nsecond\n> > four d\n> > five e\nthird"),
        (1, 4, "u", "> first\n> second\nok"),
        (2, 1, "u", "> two b\n> three c\nelsewhere"),
    ]
    out = quotations.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.n_quotes, r.n_linked) for r in out.collect()}
    assert got == {(1, 0): (None, 0, 0, 0), (1, 1): (0, 0, 1, 1), (1, 2): (None, 2, 1, 0), (1, 3): (1, 0, 2, 2), (1, 4): (3, 0, 1, 1), (2, 1): (None, 1, 1, 0)}
