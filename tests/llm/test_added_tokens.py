import random

from strandlake.llm import packing


def test_encoder_equals_the_tokenizer_as_given(spark):
    """With the file's added tokens, in the tokenizer's default setting; packing uses it."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own, rng = packing.Encoder(added=packing.added_tokens()), random.Random(5)
    parts = ["ab", "The", " ", "  ", "\n", ",", "é", "<|endoftext|>", "<|endoftext|>", "<|endof", "ß"]
    for _ in range(2000):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        assert own.encode(s).tolist() == t.encode(s, add_special_tokens=False).ids, repr(s)
    text = "a <|endoftext|> b"
    rows = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    ids = [*t.encode(text, add_special_tokens=False).ids, packing.END]
    assert {r.ids_crc32 for r in rows if r.doc_id == 1} & {packing.crc(packing.np.array(x, "<u2")) for x in (ids, ids[:-1])}
