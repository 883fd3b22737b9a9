"""Token alignment against a plain version with the tokenizers of the files themselves."""

import hashlib
import os
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismata.llm import token_alignment as ta

pytestmark = pytest.mark.skipif(not os.path.isdir(ta.FOLDER), reason="no tokenizers")
TEXTS = [
    "Hello world, this is a test.",
    None,
    "",
    " ",
    "  two spaces  in a row ",
    "it's we'll I'M 12345 67,8.9 <|endoftext|> <s> </s> <unk>",
    "Größe naïve señor ciónrrñco — “quotes” … 日本語テスト 🙂🙂 ▁ x",
    "Hello world, this is a test.",
    "line\none \n two\n\n  three\t\ttabs\r\nend\n",
    "a" * 5000,
    "ab cd " * 3000 + "x",
    " x 　y ​ ź ﬁ \x00 \x7f",
]


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{ta.FOLDER}/{ta.FILE_A}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{ta.FOLDER}/{ta.FILE_B}")


def _plain_raw(a, b):
    letters = ta._byte_letters()

    def of_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    return lambda i: bytes(letters[c] for c in a.id_to_token(i)), of_b


def _ends(ids, raw):
    out, at = [], 0
    for i in ids:
        at += len(raw(i))
        out.append(at)
    return out


def plain(texts, a, b):
    raw_a, raw_b = _plain_raw(a, b)
    per_doc, total = [], Counter()
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        want = b" " + t.encode() if t else b""
        if not t or b"".join(map(raw_a, ids_a)) != want or b"".join(map(raw_b, ids_b)) != want:
            per_doc.append(None)
            continue
        ea, eb = _ends(ids_a, raw_a), _ends(ids_b, raw_b)
        both = set(ea) & set(eb)
        parts, x, y = [], [], []
        i = j = 0
        for cut in sorted(both):
            x, y = [], []
            while i < len(ea) and ea[i] <= cut:
                x.append(ids_a[i])
                i += 1
            while j < len(eb) and eb[j] <= cut:
                y.append(ids_b[j])
                j += 1
            parts.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        links = Counter()
        i = j = 0
        while i < len(ea):  # overlapping ranges, by merging
            links[ids_a[i], ids_b[j]] += 1
            step = ea[i] - eb[j]
            i, j = i + (step <= 0), j + (step >= 0)
        total += links
        per_doc.append((len(ids_a), len(ids_b), len(parts), links, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if d is None else (d[0], d[1], d[2], sum(d[3].values()), sum(k for p, k in d[3].items() if total[p] == most[p[1]]), sum(k * total[p] for p, k in d[3].items()), d[4])
        for d in per_doc
    ]


@pytest.mark.parametrize("hot", [ta.HOT, 5])
def test_documents_equal_plain_version(spark, sides, hot):
    rows = [(n if n != 3 else None, t, "clash") for n, t in enumerate(TEXTS)] + [(0, TEXTS[0], "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string")
    got = ta.Alignment(df, hot=hot).documents().collect()
    want = plain([t for _, t, _ in rows], *sides)
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *w)) for (i, _, _), w in zip(rows, want, strict=True))


def test_groups_cover_the_bytes(spark, sides):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {r.doc_id: r.groups for r in ta.Alignment(df).groups().collect()}
    raw_a, raw_b = _plain_raw(*sides)
    for n, t in enumerate(TEXTS):
        if not t or "▁" in t:
            assert found[n] == []
        for g in found[n]:
            piece = (b" " + t.encode())[g.start : g.end]
            assert b"".join(map(raw_a, g.a)) == b"".join(map(raw_b, g.b)) == piece


def test_empty_table(spark):
    al = ta.Alignment(spark.createDataFrame([], "doc_id long, text string"))
    assert al.documents().count() == al.groups().count() == al.pairs().count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8") | st.sampled_from(" \n'sab1.,é"), max_size=30), max_size=4))
def test_any_text_is_encoded_like_the_files(sides, texts):
    pair = ta.Pair(ta.byte_side(f"{ta.FOLDER}/{ta.FILE_A}"), ta.piece_side(f"{ta.FOLDER}/{ta.FILE_B}"))
    texts = [t for t in texts if t]
    (ids_a, _), (ids_b, _) = pair.encode(pa.array(texts, pa.large_string()))
    a, b = sides
    assert ids_a.tolist() == [i for t in texts for i in a.encode(" " + t, add_special_tokens=False).ids]
    assert ids_b.tolist() == [i for t in texts for i in b.encode(t)]


def test_every_character_is_encoded_like_the_files(sides):
    pair = ta.Pair(ta.byte_side(f"{ta.FOLDER}/{ta.FILE_A}"), ta.piece_side(f"{ta.FOLDER}/{ta.FILE_B}"))
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}, {chr(c)}" for c in [*range(1, 0xD800), *range(0xE000, 0x20000, 1)]]
    (ids_a, n_a), (ids_b, n_b) = pair.encode(pa.array(texts, pa.large_string()))
    a, b = sides
    want = [e.ids for e in a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert ids_a.tolist() == [i for x in want for i in x] and n_a.tolist() == list(map(len, want))
    assert ids_b.tolist() == [i for x in b.encode(texts) for i in x]


def test_cuts_without_a_common_end_inside():
    import numpy as np

    ga, gb = np.array([2, 4, 6, 8, 9]), np.array([1, 3, 5, 7, 9])
    assert [x.tolist() for x in ta.cuts(ga, gb, np.array([5]), np.array([5]))] == [[0], [5], [0], [5]]
