import array
import glob
import random
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillmark.llm import token_output

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    path = public_tokenizers.path(name)
    library, enc = Tokenizer.from_file(path), token_output.Encoder(path)
    assert enc.columnar == (name == "word_bpe_49k.json")
    rng = random.Random(3)
    pieces = ["the", "The,", "ÀÉîß", "don't", "I'VE", "'tis", "x_y", "<|endoftext|>", "a<|startoftext|>b", "İstanbul", "ΣΑΣ", "éa", "日本語", " ", "\x1c", "a\u0085b", "123", "$$$", "***end", "ª", "'s", "\t", "\n\n", "\r", "🙂🙂", "...", "A" * 80, "fi‍x"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randrange(30))) for _ in range(500)] + [None, ""]
    column = pa.array(texts, pa.string())
    ids, at = enc.encode(column)
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text
    assert enc.count(column).tolist() == [b - a for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    assert len(enc.encode(pa.array([], pa.string()))[0]) == 0 == len(enc.count(pa.array([], pa.string())))


def test_files_round_trip(spark, odd_docs, no_docs, tmp_path):
    folder = f"file://{tmp_path}/ids"
    files = token_output.write_tokens(odd_docs, folder, PATH)
    rows = token_output.read_tokens(token_output.with_bases(files)).collect()
    library = Tokenizer.from_file(PATH)
    want = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in odd_docs.collect())
    assert len(rows) == len(want)
    start = 0
    for r, (k, t) in zip(sorted(rows, key=lambda r: r.start), want, strict=True):
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        assert (r.doc_id is None) == (k == -1) and bytes(r.ids) == array.array("I", ids).tobytes() and r.start == start
        start += len(ids)
    digest = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_output.token_digest(odd_docs, PATH).collect()}
    assert digest == {(r.doc_id, r.start): (len(r.ids) // 4, zlib.crc32(bytes(r.ids))) for r in rows}
    assert token_output.token_digest(no_docs, PATH).count() == 0


def test_reader_reads_only_what_is_asked_and_checks_it(spark, odd_docs, tmp_path):
    token_output.write_tokens(odd_docs.where("doc_id > 2").coalesce(1), f"file://{tmp_path}/x", PATH).collect()
    for name in glob.glob(f"{tmp_path}/x/*.zst"):
        with open(name, "rb") as f:
            reader = token_output.FrameReader(f)
            first = int(reader.keys[0])
            assert reader.find(first) and reader.find(-5) == []
        data = bytearray(open(name, "rb").read())
        data[int(reader.offsets[0]) + int(reader.sizes[0]) - 1] ^= 1
        bad = tmp_path / "bad"
        bad.write_bytes(data)
        with open(bad, "rb") as f, pytest.raises(Exception):  # noqa: B017
            token_output.FrameReader(f).frame(0)
