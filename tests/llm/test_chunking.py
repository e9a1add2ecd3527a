import random

import pytest

from tapeglass.llm import tokens
from tapeglass.llm.chunking import Chunker, split_oversized

PATH = tokens.tokenizer_file()
RND = random.Random(8)
WORDS = "market halt auction spread ledger 12.5 handle unexpected-value quotation".split()


def prose(n):
    out = []
    for _ in range(n):
        out.append(" ".join(RND.choice(WORDS) for _ in range(RND.randrange(4, 20))).capitalize() + RND.choice([". ", "! ", ".\n", ".\n\n"]))
    return "".join(out)


TEXTS = [prose(300), "x" * 9000, "成交量是平时的倍流动性不足。" * 300, "a,b;1\n" * 3000, "  \n\t " * 2000, "word  " * 4000, "😀" * 2000, "# Head\n\n" + prose(90) + "## Next\nA: hi\nB: ho\n" * 200, "é́" * 3000]


def check(text, pieces, limit, overlap):
    at = 0
    for i, (a, z, shared, n, _) in enumerate(pieces):
        assert a + shared == at and z > at
        assert n == len(tokens.encode(PATH, text[a:z])) and n <= limit
        if i:
            assert len(tokens.encode(PATH, text[a : a + shared])) >= overlap - 2
        at = z
    assert at == len(text)


def test_pieces_fit_overlap_and_make_up_the_text():
    for text in TEXTS:
        c = Chunker(PATH, 256, 32, 100)
        p = c.pieces(text)
        assert (len(p) > 1) == (len(tokens.encode(PATH, text)) > 256)
        check(text, p, 256, 32)


def test_an_edit_alters_only_neighbouring_pieces():
    text = prose(1200)
    edited = text[:3000] + "An entirely new sentence here. " + text[3000:]
    c = Chunker(PATH, 512, 32, 200)
    a, b = ({text_[p[0] : p[1]] for p in c.pieces(text_)} for text_ in (text, edited))
    assert len(a - b) <= len(a) // 3 and len(b - a) <= len(b) // 3


def test_counter_is_exact():
    c = tokens.Counter(PATH)
    for t in [*TEXTS, "", " ", "a", " a", "a ", "a  b", "a \n b", "\n a", "it's 'tis  x", "a b 　c", "\ud800x"]:
        assert c.count(t) == len(tokens.encode(PATH, t)) == c.count(t)


def test_tables(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, TEXTS[0]), (4, TEXTS[0])], "doc_id int, text string").selectExpr("*", "'clash' as piece_no")
    out = split_oversized(d, limit=256, overlap=32, least=100).collect()
    assert [(r.doc_id, r.piece, r.boundary) for r in out if r.doc_id < 4] == [(3, "short", "end")]
    one = len(Chunker(PATH, 256, 32, 100).pieces(TEXTS[0]))
    assert sum(r.doc_id == 4 for r in out) == 2 * one
    assert {r.doc_id for r in split_oversized(d, limit=256, overlap=32, least=100, only_split=True).collect()} == {4}
    assert split_oversized(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Chunker(PATH, 100, 64, 64)
