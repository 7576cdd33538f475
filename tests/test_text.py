"""Tokenizers against the libraries, and the relational forms."""

import random

import pytest

from quern.kernels.sentencepiece import ModelError, SentencePiece
from quern.plans.text import TextOptions
from quern.sources.tokenizers import Tokenizer

WORDS = "river stone bird green seven walks under".split()


def wordlevel(frame="<{}>"):
    """A word-level model made with the library: four special tokens, then WORDS, and a frame of two tokens around each text."""
    lib = pytest.importorskip("tokenizers")
    special = [frame.format(n) for n in ("pad", "open", "close", "other")]
    model = lib.Tokenizer(lib.models.WordLevel({w: i for i, w in enumerate([*special, *WORDS])}, unk_token=special[3]))
    model.pre_tokenizer = lib.pre_tokenizers.WhitespaceSplit()
    model.post_processor = lib.processors.TemplateProcessing(single=f"{special[1]} $A {special[2]}", special_tokens=[(special[1], 1), (special[2], 2)])
    return Tokenizer.from_bytes(model.to_str().encode())


def test_lengths_of_batches(spark):
    """Cut, padded to a number and padded to the longest, against lists made by hand from the rule: frame, cut words, zeros."""
    from quern.operators.text import TextProcessor

    t = wordlevel()
    assert t.token_to_id("bird") == 6 and t.token_to_id("moon") is None and t.pad_id() == 0 and "11 tokens" in repr(t)
    r = random.Random(12)
    texts = {i: [r.choice([*WORDS, "moon"]) for _ in range(r.randint(0, 9))] for i in range(30)}
    df = spark.createDataFrame([(i, "  ".join(w)) for i, w in texts.items()], "id int, text string").repartition(3)
    number = {w: i + 4 for i, w in enumerate(WORDS)}

    def row(words, most=None, width=None):
        ids = [number.get(w, 3) for w in words]
        ids = [1, *(ids if most is None else ids[: most - 2]), 2]
        return ids + [0] * ((width or 0) - len(ids)), [1] * len(ids) + [0] * ((width or 0) - len(ids))

    def got(**options):
        return {x.id: (x.ids, x.attention_mask) for x in TextProcessor(t, TextOptions(**options)).encode_batch(df, []).collect()}

    assert got(max_length=7, padding=9) == {i: row(w, 7, 9) for i, w in texts.items()}
    longest = 2 + max(map(len, texts.values()))
    assert got(padding="longest") == {i: row(w, None, longest) for i, w in texts.items()}
    assert got(max_length=5, padding="longest") == {i: row(w, 5, 5) for i, w in texts.items()}
    with pytest.raises(Exception, match="different lengths"):
        TextProcessor(t).encode_batch(df, []).collect()


def test_frame_stays_when_little_is_left():
    t = wordlevel()
    for most in range(2, 8):
        ids = t.encode_truncated("stone under river green bird", True, most)
        assert ids == [1, *[5, 10, 4, 7, 6][: most - 2], 2]


@pytest.fixture(scope="module")
def library():
    sp = pytest.importorskip("sentencepiece")
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("piece_bpe_32k.model")
    return sp.SentencePieceProcessor(model_file=path), SentencePiece.from_bytes(open(path, "rb").read())


def test_bpe_model_equals_the_library(library):
    theirs, ours = library
    r = random.Random(1)
    alphabet = list("the quick brown fox, 12 ") + ["é", "ü", "日", "本", "👍", "  ", "\n", "\t", "Ω", "ﬁ", "　", "　"]
    texts = ["", " ", "   ", "Hello world", " leading and trailing ", "日本語テキスト"] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 40))) for _ in range(500)]
    for t in texts:
        ids = theirs.encode(t)
        assert ours.encode(t) == ids, t
        assert ours.decode(ids) == theirs.decode(ids), t
    assert ours.encode("a", True, True) == [1, *theirs.encode("a"), 2]
    assert ours.vocab_size == 32000 and ours.piece_to_id("<s>") == 1 and ours.id_to_piece(40000) is None


def test_unigram_takes_the_best_path():
    m = SentencePiece(["<unk>", "<s>", "</s>", "▁", "a", "b", "ab", "▁a"], [0, 0, 0, -1, -2, -2, -3.5, -2.5], ["unknown", "control", "control", *["normal"] * 5])
    assert m.encode("ab") == [3, 6]  # -4.5, against -4.5 of ▁a b whose last piece begins later
    assert m.encode("azzb") == [7, 0, 5]  # a run of unknown letters is one id
    assert m.decode([7, 0, 5]) == "a ⁇ b"
    assert m.normalize("  a   b ") == "▁a▁b" and m.normalize("   ") == ""


def test_bad_models():
    with pytest.raises(ModelError):
        SentencePiece.from_bytes(b"\x0a\xff")
    with pytest.raises(ModelError):
        Tokenizer.from_bytes(b"[1, 2")


def test_lowercase_is_unicode(spark):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([("ΟΔΟΣ É",)], "t string").select(F.lower("t")).first()[0] == "οδος é"
