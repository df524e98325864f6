import json
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import tokenfiles


def test_round_trip(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"Text number {i} " * (i % 7) for i in range(300)] + [None, "", "long word " * 20_000]
    rows = [(i * 3 - 100, t, 0) for i, t in enumerate(texts)] + [(None, "null id", 0), (2, "twice", 0), (2, "twice", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(7)
    index = tokenfiles.write_token_files(df, str(tmp_path / "store"), path)
    got = tokenfiles.read_token_files(spark, str(tmp_path / "store")).collect()
    assert len(got) == len(rows)
    library = Tokenizer.from_file(path)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at, flat = 0, []
    want = []
    for i, t, _ in order:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        flat += ids
        at += len(ids)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])))[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    files = json.loads((tmp_path / "store" / "index.json").read_text())
    assert files == index and sum(p["ids"] for p in files["parts"]) == at
    one = np.concatenate([np.fromfile(tmp_path / "store" / f"{p['part']}.ids", "<u2") for p in files["parts"]])
    assert len(one) == at
    assert sorted(p.suffix for p in (tmp_path / "store").iterdir() if not p.name.startswith("_") and p.name != "index.json" and p.suffix != ".crc") == sorted([".doc", ".ids", ".off"] * len(files["parts"]))


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    tokenfiles.write_token_files(df, str(tmp_path / "none"), public_tokenizers.path("word_bpe_49k.json"))
    assert tokenfiles.read_token_files(spark, str(tmp_path / "none")).collect() == []
