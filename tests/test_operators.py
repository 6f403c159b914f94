"""Operators on hand-built frames: NULL flags, zero divisors, ties, scopes, price rules."""

import datetime as dt
from decimal import Decimal as Dec

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sellerlens.functions.calendar import resolve_period
from sellerlens.operators import marts, measures, price, reports
from sellerlens.operators.scopes import in_portfolio, seller_label, seller_scopes
from sellerlens.sources import schemas

AS_OF = dt.date(2001, 7, 19)
D = dt.date


def sales_rows(spark, rows):
    base = {c.name: None for c in schemas.SALES.fields}
    full = []
    for r in rows:
        x = dict(base)
        x.update(r)
        full.append(x)
    return spark.createDataFrame([Row(**x) for x in full], schemas.SALES)


def line(seller=1, day=D(2001, 7, 10), gmv="10.00", units=1, **kw):
    r = dict(seller_id=seller, order_id=kw.pop("order_id", 1), item_id=kw.pop("item_id", 1),
             closed_date=day, gmv=Dec(gmv), units=units, gmv_flag=kw.pop("gmv_flag", True))
    r.update(kw)
    return r


def portfolio(spark, rows):
    return spark.createDataFrame(rows, schemas.PORTFOLIO)


def test_scopes_skip_single_member_groups(spark):
    pf = portfolio(spark, [(1, "a", "G1"), (2, "b", "G1"), (3, "c", "SOLO")])
    got = {(r.scope, r.seller_id) for r in seller_scopes(pf).collect()}
    assert ("G1", 1) in got and ("G1", 2) in got
    assert not any(s == "SOLO" for s, _ in got)
    assert {s for s, _ in got} == {"all", "G1", "1", "2", "3"}


def test_seller_label_falls_back_to_id(spark):
    pf = portfolio(spark, [(1, "Alpha", "G")])
    df = spark.createDataFrame([(1,), (9,)], "seller_id long")
    got = {r.seller_id: r.seller for r in seller_label(df, pf).collect()}
    assert got == {1: "Alpha", 9: "9"}


def test_portfolio_semi_join_filters(spark):
    pf = portfolio(spark, [(1, "a", "G")])
    s = sales_rows(spark, [line(1), line(2)])
    assert [r.seller_id for r in in_portfolio(s, pf).collect()] == [1]


def test_sales_monthly_window_flag_and_null_asp(spark):
    s = sales_rows(spark, [
        line(1, D(2001, 7, 10), "10.05", 2),
        line(1, D(2001, 7, 11), "0.00", 0, order_id=2),
        line(1, D(2001, 7, 19), "99.00", 1),               # as_of excluded
        line(1, D(1999, 12, 31), "99.00", 1),              # before Jan 1 of last year
        line(1, D(2001, 7, 12), "99.00", 1, gmv_flag=False),
        line(2, D(2001, 6, 1), "5.00", 0),                 # zero units -> NULL asp
    ])
    got = {(r.seller_id, r.month): r for r in marts.sales_monthly(s, AS_OF).collect()}
    jul = got[(1, D(2001, 7, 1))]
    assert jul.gmv == Dec("10.05") and jul.si == 2 and jul.asp == 5.03  # 5.025 rounds half up
    assert got[(2, D(2001, 6, 1))].asp is None
    assert len(got) == 2


def test_investments_three_valued_flags(spark):
    s = sales_rows(spark, [
        line(1, deal_subtype="pre_agreed", deal_invest=Dec("1.0000"), price_match_flag=True, smart_flag=None),
        line(1, coupon_amount=Dec("2.0000"), coupon_by_seller_flag=False),
        line(1, coupon_amount=Dec("4.0000"), coupon_by_seller_flag=None),   # NULL flag: excluded
        line(1, coupon_amount=Dec("8.0000"), coupon_by_seller_flag=True),
        line(1, dod_invest=None, auto_invest=Dec("0.5000")),
    ])
    r = marts.investments_daily(s, AS_OF).collect()[0]
    assert r.g1_pre_agreed == Dec("1.00") and r.g2_price_matching == Dec("1.00") and r.g2_smart == 0
    assert r.g3_coupons == Dec("2.00") and r.g1_dod == 0 and r.g2_auto == Dec("0.50")


def test_logistics_unclassed_only_in_total(spark):
    s = sales_rows(spark, [line(1, gmv="1.00", logistic_type="fulfillment"),
                           line(1, gmv="2.00", logistic_type="other"),
                           line(1, gmv="4.00", logistic_type=None)])
    r = marts.logistics_daily(s, AS_OF).collect()[0]
    assert r.gmv_total == Dec("7.00") and r.gmv_ff == Dec("1.00") and r.gmv_xd == 0 and r.gmv_ss == 0


def test_buybox_distinct_orders(spark):
    s = sales_rows(spark, [line(1, order_id=1, buybox_flag=True), line(1, order_id=1, buybox_flag=False),
                           line(1, order_id=2, buybox_flag=None), line(1, order_id=3, buybox_flag=False)])
    r = marts.buybox_monthly(s, AS_OF).collect()[0]
    assert (r.orders, r.orders_bb, r.gmv_bb) == (3, 1, Dec("10.00"))


def test_top_items_ties_break_on_item(spark):
    s = sales_rows(spark, [line(1, item_id=i, gmv="5.00", item_title=f"t{i}") for i in (3, 1, 2)])
    got = marts.top_items(s, AS_OF, k=2).orderBy("rank").collect()
    assert [r.item_id for r in got] == [1, 2] and got[0].title == "t1"


def test_price_rules(spark):
    obs_rows = []

    def ob(seller, item, cat, day, ours, rival, vm="1.00", **kw):
        r = dict(seller_id=seller, item_id=item, catalog_id=cat, day=day, site="HOME", type="MATCH",
                 bulky="false", our_price=Dec(ours), rival_price=None if rival is None else Dec(rival),
                 visits_match=Dec(vm), rival_name=kw.get("name", "r"), rival_url="u", permalink="p",
                 title="t")
        obs_rows.append(r)

    last = D(2001, 7, 18)
    ob(1, 10, "C1", last, "104.00", "100.00")           # > 1.03x: expensive
    ob(1, 10, "C1", last, "104.00", None, name="null")  # NULL rival sorts first
    ob(1, 11, "C1", last, "103.00", "100.00")           # exactly 1.03x: competitive
    ob(2, 12, "C2", last, "50.00", "0.00", vm="0.00")   # zero exposure: dropped by HAVING
    ob(3, 13, "C3", D(2001, 7, 10), "9.00", "1.00")     # not on the last day
    obs = spark.createDataFrame([Row(**r) for r in obs_rows], schemas.PRICE_OBS)
    audit = spark.createDataFrame([
        Row(arrival_ts=dt.datetime(2001, 7, 18, 10), event_id=1,
            value=Row(seller_id=1, item_id="HOME11", item_price=Dec("200.00"), target_price=Dec("100.00"),
                      rival_name="a1", rival_url=None, permalink=None, is_offender=True, qualification="C2")),
        Row(arrival_ts=dt.datetime(2001, 7, 18, 10), event_id=2,   # same time, higher id wins
            value=Row(seller_id=1, item_id="HOME11", item_price=Dec("300.00"), target_price=Dec("100.00"),
                      rival_name="a2", rival_url=None, permalink=None, is_offender=True, qualification="C3")),
    ], schemas.PRICE_AUDIT)
    assert price.last_day(obs, AS_OF).collect()[0].max_day == last
    items = {r.item_id: r for r in price.items_last_day(obs, AS_OF).collect()}
    assert items[10].rival_price is None and items[10].rival_name == "null"
    out = {r.item_id: r for r in price.price_competitiveness(obs, audit, AS_OF, dt.datetime(2001, 7, 19),
                                                             days=15, audit_days=3).collect()}
    assert set(out) == {10, 11}
    assert out[10].classification == "Competitivo"  # NULL rival (cheapest row) -> not comparable
    assert out[11].our_price == Dec("300.00") and out[11].qualification == "C3"
    assert out[11].classification == "Nao Competitivo"
    exp = {r.catalog_id: r for r in price.exposure(obs, AS_OF).collect()}
    assert exp["C1"].visits_exp3 == Dec("1.00") and "C2" not in exp


def test_reputation_class_and_label(spark):
    levels = ["green_platinum", "green_gold", "green", "yellow", "orange", "red", None, "", "purple"]
    df = spark.createDataFrame([(lv,) for lv in levels], "lv string")
    got = [(r.c, r.l) for r in df.select(reports.reputation_class("lv").alias("c"),
                                         reports.reputation_label("lv").alias("l")).collect()]
    assert got == [("platinum", "Platinum"), ("gold", "Gold"), ("green", "Verde"), ("yellow", "Amarelo"),
                   ("orange", "Laranja"), ("red", "Vermelho"), ("green", "-"), ("green", "-"), ("red", "purple")]


def test_kpi_delta_zero_and_missing_comparisons(spark):
    pf = portfolio(spark, [(1, "a", "G"), (2, "b", "G")])
    bridge = seller_scopes(pf)
    m = spark.createDataFrame([
        (D(2001, 7, 1), 1, Dec("150.00"), 3), (D(2001, 6, 1), 1, Dec("100.00"), 2),
        (D(2001, 7, 1), 2, Dec("10.00"), 1),
    ], "month date, seller_id long, gmv decimal(28,2), si long")
    got = {r.scope: r for r in measures.kpi_delta(m, None, ["gmv"], resolve_period(AS_OF, "month"), bridge).collect()}
    assert got["1"].gmv == Dec("150.00") and got["1"].gmv_d1 == pytest.approx(50.0) and got["1"].gmv_d2 is None
    assert got["2"].gmv_d1 is None  # previous month absent -> no delta
    assert got["all"].gmv == Dec("160.00") and got["G"].gmv == Dec("160.00")
    y = {r.scope: r for r in measures.kpi_delta(m, None, ["gmv"], resolve_period(AS_OF, "year"), bridge).collect()}
    assert y["1"].gmv == Dec("250.00") and y["1"].gmv_d1 is None


def test_monthly_series_zero_fills_and_daily_series_skips(spark):
    pf = portfolio(spark, [(1, "a", "G")])
    bridge = seller_scopes(pf)
    m = spark.createDataFrame([(D(2001, 2, 1), 1, Dec("5.00"), 1)],
                              "month date, seller_id long, gmv decimal(28,2), si long")
    ser = measures.monthly_series(m, ["gmv"], resolve_period(D(2001, 3, 15), "quarter").months, bridge)
    assert ser.where("scope = 'all'").count() == 3 and ser.where("scope = 'all' and gmv = 0").count() == 2
    d = spark.createDataFrame([(D(2001, 7, 1), 1, Dec("5.00"), 1)],
                              "day date, seller_id long, gmv decimal(28,2), si long")
    assert measures.daily_series(d, "gmv", D(2001, 6, 1), D(2001, 7, 18), bridge).where("scope='1'").count() == 1


def test_growth_uses_previous_present_month(spark):
    pf = portfolio(spark, [(1, "a", "G")])
    bridge = seller_scopes(pf)
    m = spark.createDataFrame([(D(2000, 3, 1), 1, Dec("100.00"), 1), (D(2001, 1, 1), 1, Dec("50.00"), 1),
                               (D(2001, 3, 1), 1, Dec("200.00"), 1)],
                              "month date, seller_id long, gmv decimal(28,2), si long")
    got = {r.month: r for r in measures.growth_series(m, bridge).where("scope = '1'").collect()}
    assert got[D(2001, 3, 1)].mom_pct == pytest.approx(300.0)   # vs Jan (Feb absent)
    assert got[D(2001, 3, 1)].yoy_pct == pytest.approx(100.0)
    assert got[D(2000, 3, 1)].mom_pct is None


def test_campaign_discount_rules(spark):
    pf = portfolio(spark, [(1, "a", "G")])
    bridge = seller_scopes(pf)
    c = spark.createDataFrame([
        ("SMART", D(2001, 7, 1), 1, 1, True, True, Dec("100.00"), Dec("80.00"), "s", Dec("9.00")),
        ("BANK", D(2001, 7, 1), 1, 2, True, False, Dec("0.00"), Dec("80.00"), "s", Dec("8.00")),
        ("ODD", D(2001, 7, 1), 1, 3, True, False, Dec("10.00"), None, "s", Dec("7.00")),
    ], "type string, day date, seller_id long, item_id long, eligible boolean, opt_in boolean, "
       "price_initial decimal(18,2), price_final decimal(18,2), status string, gmv_l30d decimal(18,2)")
    got = {r.item_id: r for r in reports.campaign_item_table(c, bridge, pf).where("scope = 'all'").collect()}
    assert got[1].discount_pct == pytest.approx(20.0) and got[1].type_label == "Smart"
    assert got[2].discount_pct is None and got[2].type_label == "Banco"
    assert got[3].discount_pct is None and got[3].type_label == "ODD"
    s = {r.seller_id: r for r in reports.campaign_seller_summary(c, bridge, pf).where("scope = 'all'").collect()}
    assert (s[1].total, s[1].eligible, s[1].opt_in) == (3, 3, 1)


def test_qualification_first_non_null_in_mart_order(spark):
    pf = portfolio(spark, [(1, "a", "G")])
    bridge = seller_scopes(pf)
    cols = ("seller_id long, item_id long, visits_match decimal(18,2), visits_exp3 decimal(18,2), "
            "our_price decimal(18,2), rival_price_min decimal(18,2), rival_name string, rival_url string, "
            "permalink string, title string, qualification string, classification string")
    p = spark.createDataFrame([
        (1, 1, Dec("9"), Dec("9"), Dec("2"), Dec("1"), "r", None, None, "t", None, "Nao Competitivo"),
        (1, 2, Dec("9"), Dec("5"), Dec("2"), Dec("1"), "r", None, None, "t", "C3", "Nao Competitivo"),
        (1, 3, Dec("9"), Dec("1"), Dec("1"), Dec("1"), "r", None, None, "t", "C1", "Competitivo"),
    ], cols)
    r = reports.qualification_table(p, bridge, pf).where("scope = 'all'").collect()[0]
    assert (r.qualification, r.qual_rank, r.benefit_eligible, r.non_competitive) == ("C3", 3, False, 2)
    items = reports.price_item_table(p, bridge, pf, k=1).where("scope = 'all'").collect()
    assert len(items) == 1 and items[0].item_id == 1 and items[0].gap_pct == pytest.approx(100.0)


PRICE_MART = ("seller_id long, item_id long, visits_match decimal(18,2), visits_exp3 decimal(18,2), "
              "our_price decimal(18,2), rival_price_min decimal(18,2), rival_name string, rival_url string, "
              "permalink string, title string, qualification string, classification string")


def price_row(seller, item, visits, expensive, qualification=None):
    return (seller, item, Dec(visits), Dec(expensive), Dec("2"), Dec("1"), "r", None, None, "t", qualification, "Nao Competitivo")


def test_band_is_of_the_shown_percentage(spark):
    pf = portfolio(spark, [(k, f"s{k}", "G") for k in range(1, 7)])
    shares = {1: "3004.00", 2: "3006.00", 3: "1004.00", 4: "1005.00", 5: "3000.00", 6: "0.00"}
    p = spark.createDataFrame([price_row(k, 1, "10000.00", v) for k, v in shares.items()], PRICE_MART)
    got = {r.seller_id: r.band for r in reports.price_seller_table(p, seller_scopes(pf), pf).where("scope = 'all'").collect()}
    assert got == {1: "medium", 2: "high", 3: "low", 4: "medium", 5: "medium", 6: "low"}


def test_empty_qualification_is_none(spark):
    pf = portfolio(spark, [(1, "a", "G"), (2, "b", "G")])
    p = spark.createDataFrame([price_row(1, 1, "9", "9", ""), price_row(1, 2, "9", "5", "C2"), price_row(2, 1, "9", "9", "")], PRICE_MART)
    got = reports.qualification_table(p, seller_scopes(pf), pf).where("scope = 'all'").collect()
    assert [(r.seller_id, r.seller, r.qualification) for r in got] == [(1, "a", "C2")]


def test_price_cut_takes_seller_ids_as_text(spark):
    day = D(2001, 7, 18)
    obs = spark.createDataFrame([Row(
        seller_id=s, item_id=1, catalog_id="C1", day=day, site="HOME", type="MATCH", bulky="false", our_price=Dec("1.00"),
        rival_price=Dec("1.00"), visits_match=Dec("1.00"), rival_name="r", rival_url="u", permalink="p", title="t",
    ) for s in (9, 10, 200, 70123968)], schemas.PRICE_OBS)
    audit = spark.createDataFrame([], schemas.PRICE_AUDIT)
    args = (obs, audit, AS_OF, dt.datetime(2001, 7, 19))
    assert [r.seller_id for r in price.price_competitiveness(*args, limit=3).collect()] == [10, 200, 70123968]
    assert price.price_competitiveness(*args).count() == 4


def test_scope_names_mean_one_thing(spark):
    """A group named like a seller id, or "all", never mixes members into another scope."""
    pf = portfolio(spark, [(1, "a", "2"), (2, "b", "X"), (3, "c", "2"), (4, "d", "all"), (5, "e", "all")])
    got = {}
    for r in seller_scopes(pf).collect():
        got.setdefault((r.scope, r.scope_kind), []).append(r.seller_id)
    assert {k: sorted(v) for k, v in got.items()} == {
        ("all", "all"): [1, 2, 3, 4, 5], ("2", "group"): [1, 3],
        ("1", "seller"): [1], ("3", "seller"): [3], ("4", "seller"): [4], ("5", "seller"): [5]}


def test_repeated_portfolio_rows_count_once(spark):
    pf = portfolio(spark, [(1, "a", "G"), (1, "a", "G"), (2, "b", "G")])
    m = spark.createDataFrame([(D(2001, 7, 1), 1, Dec("5.00"), 1)], "month date, seller_id long, gmv decimal(28,2), si long")
    got = {r.scope: r.gmv for r in measures.sum_months(m, ["gmv"], [D(2001, 7, 1)], seller_scopes(pf)).collect()}
    assert got == {"all": Dec("5.00"), "G": Dec("5.00"), "1": Dec("5.00"), "2": Dec("0")}
    table = reports.seller_sales_table(m, None, resolve_period(AS_OF, "month"), seller_scopes(pf), pf)
    assert [(r.seller_id, r.seller) for r in table.where("scope = 'all'").collect()] == [(1, "a")]


def test_repeated_titles_do_not_fan_out(spark):
    s = sales_rows(spark, [line(1, item_id=7, buybox_flag=True), line(1, item_id=8, gmv="5.00")])
    titles = spark.createDataFrame([(7, "old"), (7, "seven"), (9, "nine")], "item_id long, item_title string")
    for pf in (None, portfolio(spark, [(1, "a", "G")])):
        got = [(r.item_id, r.title, r["rank"]) for r in marts.top_items(s, AS_OF, pf, titles=titles).orderBy("rank").collect()]
        assert got == [(7, "seven", 1), (8, None, 2)]


def test_reports_take_every_seller_of_the_campaigns(spark):
    """More rows than the reference's own cut: no seller is lost."""
    rows = [("SMART", D(2001, 7, 1), s, i, True, True, Dec("9.00"), Dec("8.00"), "s", Dec(f"{s}.00")) for s in range(40) for i in range(50)]
    c = spark.createDataFrame(rows, "type string, day date, seller_id long, item_id long, eligible boolean, opt_in boolean, "
                                    "price_initial decimal(18,2), price_final decimal(18,2), status string, gmv_l30d decimal(18,2)")
    pf = portfolio(spark, [(s, f"s{s}", "G") for s in range(40)])
    bridge = seller_scopes(pf)
    assert reports.campaign_seller_summary(c, bridge, pf).where("scope = 'all'").count() == 40
    top = reports.campaign_item_table(c, bridge, pf, k=120).where("scope = 'all'").collect()
    assert sorted({r.seller_id for r in top}) == [37, 38, 39] and sorted(r["rank"] for r in top) == list(range(1, 121))


def test_large_portfolio_is_applied_to_rows_by_salt(spark):
    from sellerlens.operators.scopes import in_portfolio_salted

    df = spark.createDataFrame([(s, i) for s in (1, 2) for i in range(300)], "seller_id long, item_id long")
    pf = portfolio(spark, [(1, "a", "G"), (1, "a", "G"), (3, "c", "G")])
    got = in_portfolio_salted(df, pf, "item_id")
    assert got.columns == df.columns and got.count() == 300 and got.select("seller_id").distinct().first()[0] == 1
