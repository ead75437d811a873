import numpy as np

from tessella.functions.embed import embed
from tessella.operators import search


def test_near_texts_have_near_vectors(spark):
    texts = ["the parser reads source files", "a parser that reads a source file", "bananas ripen in the warm sun", "", None, "...", "word " * 3000, "Straße", "strasse"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = {r.id: (r.embedding, r.embed_model) for r in embed(chunks).collect()}
    assert len(rows) == len(texts) and all(rows[i] == (None, None) for i in (3, 4, 5)) and rows[0][1] == "hashed-features-256"
    v = {i: np.array(x) for i, (x, _) in rows.items() if x is not None}
    assert all(len(x) == 256 and abs(np.linalg.norm(x) - 1) < 1e-5 for x in v.values())
    assert v[0] @ v[1] > 0.35 > v[0] @ v[2]
    # What a search needs of it: the nearest of the texts, without outside vectors.
    asked = embed(spark.createDataFrame([(100, "parsers of source files")], "id long, text string")).first().embedding
    found = search.cosine_top(embed(chunks), [float(x) for x in asked], 2).collect()
    assert {r.id for r in found} == {0, 1}
