"""Queries against their SQL on small tables that show where the two went apart."""

import duckdb

from evidra.plans import catalog


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL on the given tables, sorted."""
    duck = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    want = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    key = lambda r: repr(tuple(r))
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key), sorted(want.fetchall(), key=key)


def test_consensus_maps_case_by_character(spark, tmp_path):
    """Sharp s, ligatures, Greek with iota and final sigma, in English texts that the second pass meets again."""
    texts = ["Gro\u00dfe Stra\u00dfe", "\ufb01nal o\ufb03ce \u0149", "\u1f80\u1fb3\u1fb4 \u0390", "\u039f\u0394\u039f\u03a3 \u0130", "plain"]
    rows = [(n, t + " x" * 300, "en", len(t) + 600) for n, t in enumerate(texts)]
    rows += [(n + 10, t.replace("\u00df", "\u1e9e") + " y" * 300, lang, 700) for n, (t, lang) in enumerate(zip(texts, ["de", "en", "de", "en", "de"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got, want = both(spark, tmp_path, "consensus_of_passes", documents=docs)
    assert got == want and len(got) == 10


def test_draft_prices_are_compared_as_they_are(spark, tmp_path):
    """Prices whose sum with 5 is rounded down to a difference under 5, and prices with parts of a cent."""
    prices = [p for n in range(1, 500) for p in [131072 - n / 100, 262144 - n / 100, 16384 - n / 100] if (p + 5) - p < 5][:40] + [10.005, 1.2349, 0.285, 7.0]
    orders = spark.createDataFrame([(16 + 22 * n, "O", "1-URGENT", p) for n, p in enumerate(prices)], "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double")
    got, want = both(spark, tmp_path, "draft_conflicts", orders=orders)
    assert got == want and len(prices) > 4 and [r[0] for r in got if r[1] == "price"] == [16 + 22 * n for n in range(len(prices) - 4, len(prices))]
