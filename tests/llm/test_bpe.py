import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foldcast.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "aab  ctsreéñ漢字🙂\n\t1234.,!< 　\x1c\x85"


def texts():
    rng = random.Random(1)
    out = ["".join(rng.choice(LETTERS + "'" * (rng.random() < 0.3) + "<|endoftext|>" * (rng.random() < 0.1)) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    return [*out, None, "", "a" * 20000, "<|endoftext|>" * 3 + "x", " " * 3000, "it's  we'll", "=-" * 4000, "same", "same"]


def test_ids_and_text_equal_the_library(spark):
    rows = [(i, t, "extra") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in bpe.encode(docs, PATH).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    assert bpe.encode(docs, PATH).first().doc_id is None


@pytest.mark.parametrize(("part", "value"), [("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("decoder", None), ("model", {"type": "BPE", "ignore_merges": True})])
def test_other_settings_are_refused(tmp_path, part, value):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec[part] = {**spec["model"], **value} if part == "model" else value
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="ignore_merges" if part == "model" else part):
        bpe.Coder(str(tmp_path / "other.json"))
