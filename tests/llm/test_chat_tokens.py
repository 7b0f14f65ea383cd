"""Chat formatting as an exact round trip; token counts against the library itself."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from llm.odd import TEXTS, no_documents, odd_documents
from wideframe.llm import chat, token_counts as tc

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TRICKY = [r"\### Assistant: </turn> ok", "<turn><text></turn>", "\\", "\\\\<turn>", "<\\turn>", "<|endoftext|>", "", "  a\n\n b ", "ä漢😀", "### User:" * 50, "<tur", "n>"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.lists(st.sampled_from(["\\", *chat.CONTROLS, "<", ">", "turn", "#", " ", "a"])).map("".join)))
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROLS)


def test_round_trip(spark):
    rng = random.Random(2)
    turns = [(c, t, rng.choice(["user", "assistant", "system", None, "<turn>"]), rng.choice([*TRICKY, None])) for c in [*range(12), None] for t in range(rng.randrange(1, 9))]
    turns += [(77, t, "assistant" if t % 2 else "user", f"turn {t} " + TRICKY[t % len(TRICKY)]) for t in range(700)]  # one long conversation
    turns += [(78, None, "user", "first"), (78, 1, "user", "b"), (78, 1, "assistant", "b"), (78, 1, "assistant", "b")]
    df = spark.createDataFrame([(*t, 1.5, "x") for t in turns], "conv_id long, turn long, role string, text string, ids double, start string").repartition(5)
    whole = chat.assemble(df, BYTES).cache()
    rows = chat.read_turns(whole, BYTES).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([(r.conv_id, r.turn, r.role, r.text) for r in rows], key=key) == sorted([(c, t, r or "", x or "") for c, t, r, x in turns], key=key)
    assert all(r.loss_text == (r.text if r.role == "assistant" else "") for r in rows)
    expected = {}
    for c, t, role, text in sorted(turns, key=lambda x: (x[0] is not None, x[0], x[1] is not None, x[1], x[2] or "", x[3] or "")):
        e = expected.setdefault(c, [0, "", "", 0])
        role, text = role or "", text or ""
        e[0] += 1
        e[1] += f"{role}\n{text}\n"
        e[2] += text if role == "assistant" else ""
        e[3] += len("<turn>" + chat.escape(role) + "<text>" + chat.escape(text) + "</turn>")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = {r.conv_id: r for r in chat.conversation_digests(whole, BYTES).collect()}
    assert set(digests) == set(expected)
    for c, (n, everything, loss, chars) in expected.items():
        r = digests[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == (n, sha(everything), len(loss), sha(loss), chars)
    starts = sorted((r.turn, r.start, len(r.ids)) for r in whole.filter("conv_id = 77").collect())
    assert [s for _, s, _ in starts] == [sum(n for _, _, n in starts[:k]) for k in range(len(starts))]
    assert all(len(r.ids) == len(r.loss) for r in whole.collect())
    whole.unpersist()


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digests(chat.assemble(empty, BYTES), BYTES).count() == 0


@pytest.fixture
def cache(spark, tmp_path):
    return str(tmp_path / "cache")


def counts(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect())


def expected(limit):
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [*TEXTS.items(), (1, TEXTS[1]), (-1, TEXTS[1]), (-1, None)]
    return sorted((k, len((t or "").encode()), len(pieces.encode(t or "")), len(pieces.encode(t or "")) > limit) for k, t in rows)


def test_counts_and_cache(spark, cache, monkeypatch):
    docs = odd_documents(spark)
    assert counts(tc.token_counts(docs.filter("doc_id < 10"), PIECES, cache)) != []
    before = spark.read.parquet(cache).count()
    assert counts(tc.token_counts(docs, PIECES, cache, limit=100)) == expected(100)
    stored = spark.read.parquet(cache)
    assert stored.count() > before and stored.count() == stored.select("content").distinct().count()
    after = stored.count()
    assert counts(tc.token_counts(docs, PIECES, cache, limit=100)) == expected(100)  # nothing is missing now
    assert spark.read.parquet(cache).count() == after
    other = counts(tc.token_counts(docs, BYTES, cache))
    assert spark.read.parquet(cache).count() == 2 * after and other != expected(4096)  # another vocabulary shares nothing


def test_counts_beyond_the_broadcast_bound(spark, cache, monkeypatch):
    monkeypatch.setattr(tc, "BROADCAST_DIGESTS", 0)
    assert counts(tc.token_counts(odd_documents(spark), PIECES, cache)) == expected(tc.LIMIT)


def test_no_documents(spark, cache):
    assert tc.token_counts(no_documents(spark), PIECES, cache).count() == 0


def test_special_strings_as_the_library_has_them(spark, cache):
    texts = ["<s> a </s>", "<unk>", "<|endoftext|> b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BYTES)
    assert [r.n_tokens for r in tc.token_counts(docs, BYTES, cache).orderBy("doc_id").collect()] == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
