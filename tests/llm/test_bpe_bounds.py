"""One pass of encoding and decoding: bounded tables change nothing, given columns give way."""

import public_tokenizers
import tokenizers
from seqcurate.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_forgetting_changes_no_id(sf_dir, spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(bpe, "PAIRS", 20)
    monkeypatch.setattr(bpe, "TRANSITIONS", 20)
    codec, library = bpe.Codec(bpe.read_vocabulary(PATH)), tokenizers.Tokenizer.from_file(PATH)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(150).collect()]
    for text in [*texts, "漢字仮名交じり文 😀👍🏽 naïve café x\r\n\t  y", "<|endoftext|>" * 3, "a" * 5000]:
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(codec.known) <= 20 and len(codec.automaton.learned) <= 20 and codec.memory.held <= 3000 + 1000


def test_one_pass_with_clashing_names(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 40)  # rows are handed on in several pieces
    library = tokenizers.Tokenizer.from_file(PATH)
    given = odd_docs.withColumnsRenamed({"score": "decoded", "kept": "n.tokens"})
    got = bpe.encode(given, PATH, decoded="decoded")
    assert got.columns == [c for c in given.columns if c not in ("ids", "decoded")] + ["ids", "decoded"] and got.count() == 12
    for r in got.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")
    over = bpe.encode(odd_docs, PATH, decoded="text")
    assert over.columns.count("text") == 1 and sorted(r["text"] for r in over.collect()) == sorted((r["text"] or "") for r in odd_docs.collect())
