import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from papertide.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(pieces.model_bytes())


def plain_merges(library, text):
    """Of all neighbours the best piece, the first of equals, is joined, until none is a piece."""
    score = {library.id_to_piece(i): library.get_score(i) for i in range(library.vocab_size()) if not (library.is_control(i) or library.is_byte(i) or library.is_unknown(i))}
    symbols = list(library.normalize(text))
    while found := [(-score[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in score]:
        i = min(found)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols


def test_the_agenda_is_the_plain_definition(library, own):
    r = random.Random(3)
    for _ in range(300):
        chunk = "".join(r.choice("▁theingaeo  ") for _ in range(r.randrange(1, 40))).replace(" ", "▁")
        want = [library.piece_to_id(s) for s in plain_merges(library, chunk)]
        assert own.merged(library.normalize(chunk)) == want


@pytest.mark.parametrize("most", [1, 7, 40, 10**6])
def test_parts_are_the_whole(library, own, most):
    r = random.Random(most)
    letters = " ▁ab<>0x\n\té漢\x00\U0001f600　 th  ing  "
    for _ in range(400):
        text = "".join(r.choice(letters) for _ in range(r.randrange(60)))
        parts = list(own.encode(text, most))
        ids = [i for p, _ in parts for i in p]
        assert ids == library.encode(text, add_eos=True)
        assert all(ok for _, ok in parts)
        assert " ".join(library.decode(p) for p, _ in parts) == library.decode(ids)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    small = pieces.Pieces(pieces.model_bytes())
    text = " ".join(f"word{k % 11}" for k in range(200))
    assert [i for p, ok in small.encode(text) for i in p] == library.encode(text, add_eos=True) and len(small) <= 3


def test_all_rows(docs, rows, library, same):
    def want(text):
        ids = library.encode(text or "", add_eos=True)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), True

    expected = [(r[0], *want(r[1])) for r in rows]
    same(pieces.digests(docs), expected, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees")


def test_encode_and_decode(spark, docs, rows, library, same):
    found = pieces.encode(docs)
    same(found, [(r[0], library.encode(r[1] or "", add_eos=True), True) for r in rows], "doc_id", "ids", "agrees")
    # every text of these comes back, but for the space mark, which reads as a space
    same(pieces.decode(found), [(r[0], r[1] or "") for r in rows], "doc_id", "text")


def test_empty_table_and_names(empty, make):
    assert pieces.digests(empty).collect() == []
    assert pieces.digests(empty).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
    row = pieces.digests(make([(7, None)]).withColumnRenamed("kind", "ids_sha256")).first()
    assert (row.doc_id, row.n_tokens, row.ids_sha256) == (7, 1, hashlib.sha256(b"2").hexdigest())


def test_a_long_text(spark, library):
    r = random.Random(5)
    text = " ".join("".join(r.choice("abcdeé.\n") for _ in range(r.randrange(1, 12))) for _ in range(400_000))
    row = pieces.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    ids = library.encode(text, add_eos=True)
    assert row.agrees and row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_side_by_side(own):
    """Many chunks at once, and each by its own agenda."""
    r = random.Random(8)
    chunks = ["".join(r.choice("▁" if not k else "theingaeoàß") for k in range(r.randrange(2, 30))) for _ in range(500)]
    chunks = [c for c in chunks if own.chunk.fullmatch(c)]
    assert len(chunks) > 300
    assert list(own.merged_together(chunks)) == [tuple(own.merged(c)) for c in chunks]
