import datetime as dt
from decimal import Decimal as D

import pytest

from saleslens.plans import finance

from conftest import plan_of, values

TRANSACTIONS = (
    "transaction_id long, customer_id long, amount decimal(20,2), transaction_date timestamp_ntz, "
    "transaction_status string, transaction_type string, merchant_category string, device_type string, "
    "is_fraudulent int, location_city string, location_country string"
)


def at(day, hour=9, month=1, year=2024):
    return dt.datetime(year, month, day, hour)


def move(id_, customer, amount, when, status="completed", kind="purchase", category="food", device="mobile", fraud=0):
    return (id_, customer, D(str(amount)), when, status, kind, category, device, fraud, "Rome", "Italy")


@pytest.fixture
def make(frame):
    def tables(transactions, customers=((1, "Ann", "low", 500), (2, "Bob", "high", 700)), accounts=()):
        return {
            "customers": frame(
                list(customers), "customer_id long, customer_name string, income_bracket string, credit_score long"
            ),
            "accounts": frame(
                [(c, t, D(b)) for c, t, b in accounts], "customer_id long, account_type string, balance decimal(20,2)"
            ),
            "financial_transactions": frame(list(transactions), TRANSACTIONS),
        }

    return tables


def test_zscore_levels(make):
    usual = [move(i, 1, 100 + i % 2, at(1)) for i in range(20)]
    tables = make(
        [
            *usual,
            move(30, 1, 5000, at(2), kind="transfer", fraud=1),
            move(31, 2, 10, at(1)),
            move(32, 2, 10, at(2)),
            move(40, 1, 9, at(3), status="pending"),
        ]
    )
    rows = {r.transaction_id: r for r in finance.fin_zscore_rows(tables).collect()}
    assert set(rows) == {*range(20), 30}, "customer 2 has too few purchases; pending rows do not count"
    assert rows[30].anomaly_level == "High Anomaly" and rows[30].avg_amount == 100.5 and rows[30].std_amount == 0.5
    levels = {r.anomaly_level: r for r in finance.fin_zscore_anomalies(tables).collect()}
    assert levels["High Anomaly"].fraud_capture_rate == 100.0 and levels["Normal"].transaction_count == 20


def test_zscore_without_spread_is_normal(make):
    tables = make([move(i, 1, 7, at(1)) for i in range(3)])
    rows = finance.fin_zscore_rows(tables).collect()
    assert {(r.z_score, r.anomaly_level) for r in rows} == {(None, "Normal")}


def test_zscore_same_for_every_partitioning(make):
    tables = make([move(i, 1 + i % 2, 100 + i * i % 50, at(1 + i % 20)) for i in range(60)])
    plain = values(finance.fin_zscore_rows(tables))
    for parts in (1, 2, 3, 5, 7):
        moved = tables | {"financial_transactions": tables["financial_transactions"].repartition(parts)}
        assert values(finance.fin_zscore_rows(moved)) == plain


def test_a_hot_customer_is_split(spark, make):
    customers = [(i, f"c{i}", "low", 1) for i in range(200)]
    tables = make([move(i, 7 if i % 2 else i % 200, 100 + i % 50, at(1 + i % 20)) for i in range(6000)], customers)
    moves = tables["financial_transactions"].repartition(8)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        rows = finance.fin_zscore_rows(tables | {"financial_transactions": moves})
        assert len(rows.collect()) == 6000
        assert "skew=true" in plan_of(rows)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_sequences(make):
    kinds = ["purchase", "transfer", "deposit", "purchase", "transfer", "deposit"]
    moves = [move(10 - i, 1, 10 * i, at(2 * i + 1), kind=k) for i, k in enumerate(kinds)]
    moves += [move(50, 2, 1, at(1)), move(51, 2, 1, at(1), kind="deposit")]
    rows = {r.transaction_id: r for r in finance.fin_sequence_rows(make(moves)).collect()}
    assert rows[10].previous_transaction_type is None and rows[10].next_transaction_type == "transfer"
    assert rows[9].previous_amount == D("0.00") and rows[9].days_since_last_transaction == 2
    assert rows[51].previous_transaction_type == "purchase", "equal dates are ordered by id"
    got = finance.fin_sequences(make(moves)).collect()
    assert [tuple(r) for r in got] == [("purchase → transfer → deposit", 2, 25.0, 2.0)]
    assert finance.fin_sequences(make(moves), min_occurrences=1).count() == 3


def test_sequences_same_with_hot_customer(make):
    kinds = ["purchase", "transfer", "deposit"]
    moves = [move(i, 1 + (i % 3 == 0), i, at(1 + i % 9), kind=kinds[i * i % 3]) for i in range(60)]
    tables = make(moves)
    assert values(finance.fin_sequence_rows(tables, hot_rows=30, slice_rows=4)) == values(finance.fin_sequence_rows(tables))


def test_customer_summary(make):
    customers = [(1, "a", "low", 500), (2, "b", "low", 600), (3, "c", "low", 700), (4, "d", "high", 800)]
    moves = [
        move(1, 1, 10, at(1), fraud=1),
        move(2, 1, 30, at(2)),
        move(3, 1, 99, at(2), status="pending"),
        move(4, 2, 50, at(1), status="pending"),
        move(5, 4, 8, at(1)),
    ]
    accounts = [
        (1, "checking", "100"),
        (1, "checking", "200"),
        (1, "savings", "999"),
        (4, "checking", "5"),
        (4, "checking", "5"),
    ]
    got = {r.income_bracket: r for r in finance.fin_customer_summary(make(moves, customers, accounts)).collect()}
    low, high = got["low"], got["high"]
    # Customer 1 twice (two balances), customer 2 gone (only pending), customer 3 without transactions.
    assert (low.customer_count, low.avg_total_spent, low.avg_credit_score, low.avg_balance) == (3, 40.0, 566.67, 150.0)
    assert (low.avg_transactions, low.overall_fraud_rate) == (1.33, 50.0)
    # Two accounts with one balance repeat the transactions of a single customer row.
    assert (high.customer_count, high.avg_total_spent, high.avg_transactions) == (1, 16.0, 2.0)


def test_clv_without_lifetime_has_no_yearly_value(make):
    got = finance.fin_clv_quartiles(make([move(1, 1, 10, at(1)), move(2, 2, 30, at(1)), move(3, 2, 6, at(11))])).collect()
    assert [tuple(r) for r in got] == [(1, 1, 36.0, 1314.0, 2.0), (2, 1, 10.0, None, 1.0)]


def test_rfm(make):
    customers = [(i, f"c{i}", "low", 1) for i in range(3)]
    tables = make([move(i, i, 10, at(5)) for i in range(3)], customers)
    got = finance.fin_rfm_scores(tables, dt.date(2024, 2, 1)).orderBy("customer_id").collect()
    assert [(r.recency_days, r.rfm_cell) for r in got] == [(27, "111"), (27, "222"), (27, "333")]
    assert [r.customer_segment for r in got] == ["Lost Customers", "Lost Customers", "Loyal Customers"]
    segments = finance.fin_rfm_segments(tables, dt.date(2024, 2, 1)).collect()
    assert {(r.customer_segment, r.customer_count) for r in segments} == {("Lost Customers", 2), ("Loyal Customers", 1)}


def test_monthly_trend(make):
    moves = [move(i, 1, 100 * i, at(3, month=i)) for i in (1, 2, 4)]
    got = [tuple(r) for r in finance.fin_monthly_trend(make(moves)).collect()]
    assert [(r[1], r[4], r[6]) for r in got] == [(1, 100.0, None), (2, 150.0, 100.0), (4, 233.33, 100.0)]


def test_device_peak(make):
    moves = [move(1, 1, 1, at(1, 19)), move(2, 1, 1, at(2, 13)), move(3, 1, 1, at(3, 13)), move(4, 1, 1, at(4, 12), device="web")]
    literal = {r.device_type: r.peak_usage_time for r in finance.fin_device_channel(make(moves)).collect()}
    assert literal == {"mobile": "Evening", "web": "Morning"}
    fixed = {r.device_type: (r.peak_hour, r.peak_usage_time) for r in finance.fin_device_channel_fixed(make(moves)).collect()}
    assert fixed == {"mobile": (13, "Afternoon"), "web": (12, "Morning")}


def test_volume_groups_are_ordered(make):
    moves = [move(1, 1, 5, at(1), category="a"), move(2, 1, 50, at(1), category="b"), move(3, 2, 5, at(1), category="c")]
    got = [r.merchant_category for r in finance.fin_merchant_category(make(moves)).collect()]
    assert got == ["b", "a", "c"]
    row = finance.fin_geography(make(moves)).first()
    assert (row.unique_customers, row.mobile_usage_percent, row.avg_transaction_size) == (2, 100.0, 20.0)


def test_fraud_groups(make):
    moves = [move(1, 1, 10, at(1), fraud=1), move(2, 1, 30, at(1)), move(3, 1, 30, at(2))]
    got = finance.fin_fraud_deep_dive(make(moves)).collect()
    assert len(got) == 1 and got[0].transaction_day == "Monday" and got[0].fraud_rate_percent == 50.0
    assert (got[0].avg_fraud_amount, got[0].avg_legit_amount) == (10.0, 30.0)


def test_kpis_and_summary(make):
    moves = [move(1, 1, 10, at(1)), move(2, 2, 30, at(1), status="pending", device="web"), move(3, 1, 9, at(1, year=2023))]
    row = finance.fin_kpis(make(moves), dt.date(2024, 1, 1)).first()
    assert (row.total_transactions, row.success_rate, row.mobile_rate, row.active_customers) == (2, 50.0, 50.0, 2)
    rows = dict(values(finance.fin_exec_summary(make(moves))))
    assert rows["Total Customers"] == 2.0 and rows["Total Volume ($)"] == 19.0 and rows["Mobile Usage (%)"] == 100.0
    empty = dict(values(finance.fin_exec_summary(make([]))))
    assert empty["Total Transactions"] == 0.0 and empty["Total Volume ($)"] is None


def test_views(spark, make):
    tables = make([move(1, 1, "100.00", at(1), fraud=1, status="pending"), move(2, 1, "1000.01", at(1), fraud=1)])
    finance.fin_fraud_monitoring(tables, view="fraud_monitoring")
    got = spark.sql("select amount, value_category from fraud_monitoring order by amount").collect()
    assert [r.value_category for r in got] == ["Low Value", "High Value"]
    finance.fin_customer_analytics(tables, view="customer_analytics")
    assert spark.table("customer_analytics").first().diversity_score == 1
