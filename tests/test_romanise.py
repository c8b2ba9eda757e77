"""Names in other scripts meet their Latin forms."""

from harmonium.functions import text


def test_other_scripts_meet_their_latin_names(spark):
    want = {
        "Кино": "kino", "Земфира": "zemfira", "Щука": "shchuka", "Чайка": "chaika", "Μίκης": "mikes", "Ψυχή": "psukhe", "さくら": "sakura", "サクラ": "sakura",
        "きゃりー": "kyari", "しゃ": "sha", "がっこう": "gakkou", "マッチ": "matchi", "ロック 2": "rokku 2", "Björk": "bjork", "Plain Name": "plain name", "東京": "東京", "": "",
    }
    rows = spark.createDataFrame([(k,) for k in [*want, None]], "name string")
    got = {r.name: (r.full, r.clean) for r in rows.select("name", text.full_name("name").alias("full"), text.clean_name("name").alias("clean")).collect()}
    assert {k: got[k][0] for k in want} == want
    assert {k: got[k][1] for k in want} == want
    assert got[None] == ("", None)
