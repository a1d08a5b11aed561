"""Connection isolation where connections share addresses."""

import pytest
from pyspark.sql import functions as F

from traceweave.operators import isolate

PACKETS = "experiment_id string, packet_index long, src_ip string, dst_ip string, src_port int, dst_port int"
SIDE = "experiment_id string, client_ip string, client_port int, alias string, proxy_ip string, proxy_port int"
HOT, PROXY = ("10.0.0.1", 50000), ("10.0.0.251", 8080)


def _packet(index, src, dst, run="run_1"):
    return run, index, src[0], dst[0], src[1], dst[1]


@pytest.fixture(scope="module")
def capture():
    """A hot address shared by 51 connections, a rare one, packets between them and packets without an address."""
    packets = [_packet(i, HOT, PROXY) if i % 2 else _packet(i, PROXY, HOT) for i in range(400)]
    packets += [_packet(400, HOT, ("10.0.0.2", 1)), _packet(401, ("10.0.0.2", 1), HOT), _packet(402, HOT, HOT)]
    packets += [_packet(403, (None, 50000), PROXY), _packet(404, PROXY, (None, None)), _packet(405, HOT, PROXY, None)]
    packets += [_packet(406, HOT, PROXY, "run_2"), _packet(407, HOT, ("10.0.0.251", 8081)), _packet(1, HOT, PROXY)]
    side = [("run_1", *HOT, f"trace_{i % 45}", *(PROXY if i % 3 else (None, None))) for i in range(50)]
    side += [("run_1", "10.0.0.2", 1, "rare", None, None), ("run_2", "10.0.0.9", 1, "unseen", *PROXY)]
    side += [("run_1", None, 50000, "no address", None, None), ("run_1", *HOT, "port", None, 8081)]
    return packets, side


def _expected(packets, side):
    rows = []
    for run, index, src, dst, src_port, dst_port in packets:
        for way, near, far in (("up", (src, src_port), (dst, dst_port)), ("down", (dst, dst_port), (src, src_port))):
            for of, ip, port, alias, proxy_ip, proxy_port in side:
                if None in (run, *near) or (of, ip, port) != (run, *near):
                    continue
                if proxy_ip in (None, far[0]) and proxy_port in (None, far[1]):
                    rows.append((index, way, alias))
    return sorted(rows)


@pytest.mark.parametrize("limits", [{}, {"pairs": 1000}, {"pairs": 1000, "held": 10}, {"pairs": 50, "held": 1}])
def test_every_packet_meets_every_connection_of_its_address(spark, capture, limits):
    packets, side = capture
    found = isolate.connection_facing(spark.createDataFrame(packets, PACKETS), spark.createDataFrame(side, SIDE), **limits)
    rows = found.select("packet_index", "connection_direction", "alias").collect()
    assert sorted(map(tuple, rows)) == _expected(packets, side)


def test_a_hot_address_is_dealt_to_many_tasks(spark, capture):
    """Its rows came from one task before, whatever their number."""
    packets, side = capture
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = isolate.connection_facing(
            spark.createDataFrame(packets, PACKETS), spark.createDataFrame(side, SIDE), pairs=1000, held=10
        )
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == len(_expected(packets, side))
    assert max(sizes) <= sum(sizes) / 4
