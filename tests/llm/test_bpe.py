import random

import pytest

from cellarium.llm import bpe

tokenizers = pytest.importorskip("tokenizers")

RANDOM = random.Random(4)
PIECES = ["an", "in", "on", "er", "the", "ing", "tion", "re", "a", "e", "s", "t", " ", "\n", ".", "12", "é", "漢", "😀", "'s", "  "]
TEXTS = [
    "", " ", "\n", "\n\n a", "a \n b", "x\n", "\nx", " a", "a ", "\r\n\t ", "a\x1cb \x1c c", "a\x85 b", "a\u2028b c", "a\x1f b", "ab <|endoftext|> c\n", "<|endoftext|><|endoftext|>",
    "²³ ½a Ⅷ", "a\u0301b e\u0301", "it's we'll I'M", "=" * 97, " " * 300, "ab" * 3000, "a" * 5001,
    *["".join(RANDOM.choice(PIECES) for _ in range(RANDOM.randint(1, 80))) for _ in range(400)],
    *["".join(chr(RANDOM.choice([RANDOM.randint(1, 126), RANDOM.randint(160, 1000), RANDOM.randint(0x4E00, 0x9000)])) for _ in range(60)) for _ in range(200)],
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def machine():
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        return bpe.Automaton(f.read())


def ids(machine, text):
    joined = ",".join(machine.encode(text))
    return list(map(int, joined.split(","))) if joined else []


def test_encoding_is_the_librarys(machine, library):
    for text in TEXTS:
        assert ids(machine, text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_decoding_is_the_librarys(machine, library):
    for text in TEXTS:
        found = ids(machine, text)
        assert machine.decode(found) == library.decode(found, skip_special_tokens=False) == text
    assert machine.decode([110, 110]) == library.decode([110, 110], skip_special_tokens=False)


def test_full_tables_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    monkeypatch.setattr(bpe, "KEPT_ARCS", 5)
    monkeypatch.setattr(bpe, "KEPT_STATES", 7)
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        small = bpe.Automaton(f.read())
    for text in TEXTS[:120]:
        assert ids(small, text) == library.encode(text, add_special_tokens=False).ids


def test_one_last_token_for_every_prefix(machine, library):
    """The automaton over bytes is deterministic: of the tokens that end at a place exactly one has an arc."""
    for text in TEXTS[20:160]:
        for word in machine.words.findall(text)[:5]:
            data = word.encode()[:40]
            last = [-1]
            for end in range(1, len(data) + 1):
                fits = [u for n in range(1, end + 1) if (u := machine.token.get(data[end - n : end])) is not None and (n == end or machine.has_arc(last[end - n], u))]
                assert len(fits) == 1
                last += fits
            state = 0
            for place, byte in enumerate(data, 1):
                state = machine.steps[state << 8 | byte] if state << 8 | byte in machine.steps else machine._step(state, byte)
                assert machine.last[state] == last[place]


def test_a_table_is_walked_once_it_is_there(machine, monkeypatch):
    words = [b" unforgettably", b"zzzzqqxx", "ütäö".encode() * 9]
    first = [machine.encode_word(w) for w in words]
    monkeypatch.setattr(machine, "_step", None)
    assert [machine.encode_word(w) for w in words] == first


def test_documents(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (2, "the the", "z"), (2, "the the", "z"), (None, "Ünï", "w"), (5, "long " * 40000, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode_documents(df).collect()
    assert len(out) == len(rows)
    assert sorted((r.n_tokens, tuple(r.ids)) for r in out) == sorted((len(e), tuple(e)) for e in (library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows))
    assert bpe.encode_documents(df.limit(0)).count() == 0
