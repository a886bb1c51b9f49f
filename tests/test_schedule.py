"""Ramp schedule - the load tester's schedule examples."""

from rampstat.operators.schedule import build_schedule, schedule_offsets, stage_counts


def cfg(spark, initial, mx, mn_u, mx_u, inc, factor, secs, run_id=0):
    return spark.createDataFrame(
        [(run_id, float(initial), float(mx), mn_u, mx_u, inc, float(factor), float(secs))],
        "run_id bigint, initial_rate double, max_rate double, min_users int, max_users int, "
        "users_increment int, scaling_factor double, time_increment double")


def stages(spark, *a):
    return [r for r in build_schedule(cfg(spark, *a)).orderBy("stage_index").collect()]


def test_single_stage(spark):
    s = stages(spark, 10, 10, 1, 5, 1, 2.0, 60)
    assert len(s) == 1 and s[0].stage_index == 0 and s[0].target_rps == 10.0 and s[0].active_users == 1


def test_multiple_stages_double(spark):
    s = stages(spark, 1, 8, 1, 10, 1, 2.0, 60)
    assert [x.stage_index for x in s] == [0, 1, 2, 3]
    assert [x.target_rps for x in s] == [1.0, 2.0, 4.0, 8.0]
    assert all(x.duration == 60.0 for x in s)


def test_users_capped(spark):
    assert all(x.active_users == 2 for x in stages(spark, 1, 10, 2, 2, 1, 2.0, 30))


def test_rate_capped_at_max(spark):
    s = stages(spark, 1, 5, 1, 10, 1, 2.0, 10)
    assert all(x.target_rps <= 5.0 for x in s) and s[-1].target_rps == 5.0


def test_duration_constant(spark):
    s = stages(spark, 1, 100, 1, 20, 2, 2.5, 45)
    assert all(x.duration == 45.0 for x in s)
    assert s[0].stage_index == 0 and s[1].stage_index == 1
    # fold multiplies like the loop: 1, 2.5, 6.25, 15.625, 39.0625, 97.65625, capped 100
    assert [x.target_rps for x in s] == [1.0, 2.5, 6.25, 15.625, 39.0625, 97.65625, 100.0]


def test_non_growing_or_inverted_configs_give_one_stage(spark):
    assert len(stages(spark, 1, 8, 1, 10, 1, 1.0, 60)) == 1     # factor 1
    assert len(stages(spark, 5, 2, 1, 10, 1, 2.0, 60)) == 1     # max < initial
    assert len(stages(spark, 0, 8, 1, 10, 1, 2.0, 60)) == 1     # initial 0


def test_rpm_rates_match_loop_bit_for_bit(spark):
    init, mx, f = 7 / 60.0, 1900 / 60.0, 1.1
    loop, cur = [], init
    while True:
        loop.append(min(cur, mx))
        if min(cur, mx) >= mx or cur * f <= cur:
            break
        cur = cur * f
    assert [x.target_rps for x in stages(spark, init, mx, 1, 100, 1, f, 60)] == loop


def test_offsets_and_counts(spark):
    sch = build_schedule(cfg(spark, 1, 8, 1, 10, 1, 2.0, 60))
    off = {r.stage_index: (r.t0_offset_s, r.t1_offset_s) for r in schedule_offsets(sch).collect()}
    assert off == {0: (0.0, 60.0), 1: (60.0, 120.0), 2: (120.0, 180.0), 3: (180.0, 240.0)}
    assert stage_counts(sch).first().total_stages == 4


def test_a_factor_barely_above_one_equals_the_loop(spark):
    """Many blocks of stages: every rate as the loop multiplies it, bit for bit."""
    for initial, cap, factor in ((1.0, 2000.0, 1.0001), (0.3, 7.7, 1.01), (1.0, 2.0, 1.0 + 2 ** -14)):
        want, x = [initial], initial
        while x < cap and x * factor > x:
            x *= factor
            want.append(x)
        got = [r.target_rps for r in build_schedule(cfg(spark, initial, cap, 1, 9, 1, factor, 60)).orderBy("stage_index").collect()]
        assert got == [min(w, cap) for w in want]


def test_rejected_configurations_get_no_schedule(spark):
    from rampstat.operators.quality import audit_ranges, audit_run_config
    from rampstat.operators.schedule import schedulable
    from rampstat.sources import fixtures as fx
    from tests.conftest import SF01
    configs = fx.run_configs(fx.table(spark, SF01, "customer"))
    bad = {r.run_id for r in audit_ranges(configs).select("run_id").distinct().collect()}
    rate = audit_run_config(configs).where("rule IN ('initial_rate', 'max_rate', 'scaling_factor', 'time_increment')")
    bad |= {r.run_id for r in rate.select("run_id").distinct().collect()}
    kept = {r.run_id for r in build_schedule(schedulable(configs)).select("run_id").distinct().collect()}
    assert kept == {r.run_id for r in configs.select("run_id").collect()} - bad and kept


def loop_of(r):
    """The schedule of one configuration as the load tester's loop builds it."""
    rate, users, out = r.initial_rate, r.min_users, []
    while True:
        out.append((r.run_id, len(out), min(rate, r.max_rate), min(users, r.max_users), r.time_increment))
        if min(rate, r.max_rate) >= r.max_rate or rate * r.scaling_factor <= rate:
            return out
        rate, users = rate * r.scaling_factor, users + r.users_increment


def customers(spark, tmp_path):
    """120 customers as a table of the driver; their configurations, some of which break rate rules or ranges."""
    from rampstat.sources import fixtures as fx
    spark.createDataFrame([(i, i % 25, "BUILDING") for i in range(120)],
                          "c_custkey bigint, c_nationkey bigint, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    return fx.run_configs(fx.table(spark, str(tmp_path), "customer")).collect()


def test_every_configuration_gets_a_ramp_schedule(spark, tmp_path):
    """Those that break rate rules or lie outside the form's ranges too: at least one stage each."""
    from rampstat.plans.queries import QUERIES
    configs = customers(spark, tmp_path)
    got = sorted(tuple(r) for r in QUERIES["ramp_schedule"](spark, str(tmp_path)).collect())
    assert got == sorted(s for r in configs for s in loop_of(r))
    assert {r[0] for r in got} == set(range(120))


def test_every_configuration_gets_schedule_offsets(spark, tmp_path):
    """Those that break rate rules or lie outside the form's ranges too."""
    from rampstat.plans.queries import QUERIES
    want = []
    for loop in map(loop_of, customers(spark, tmp_path)):
        want += [(run, k, k * secs, k * secs + secs, len(loop)) for run, k, _, _, secs in loop]
    got = sorted(tuple(r) for r in QUERIES["schedule_offsets"](spark, str(tmp_path)).collect())
    assert got == sorted(want) and {r[0] for r in got} == set(range(120))
