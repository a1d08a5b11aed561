import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from traceweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def shuffled_records(spark, run):
    """Rows that the stages of `run` write to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def written():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for stage, n in written().items() if stage not in before)


def packet_rows(rows, experiment="run_1", client="client_1"):
    """(t, size, direction, tls, retransmission, syn) tuples as packet dicts."""
    out = []
    for i, (t, size, direction, tls, retr, syn) in enumerate(rows):
        up = direction == "up"
        out.append(
            dict(
                experiment_id=experiment,
                client_id=client,
                packet_index=i,
                timestamp_epoch=float(t),
                frame_length=size,
                src_ip="10.0.0.1" if up else "10.0.0.9",
                dst_ip="10.0.0.9" if up else "10.0.0.1",
                src_port=5000 if up else 80,
                dst_port=80 if up else 5000,
                transport_protocol="TCP",
                tcp_flags_hex="0x02" if syn else "0x10",
                tcp_syn=syn,
                tcp_ack=1 - syn,
                tcp_fin=0,
                tcp_rst=0,
                retransmission=retr,
                tls_record_lengths=list(tls),
                direction=direction,
            )
        )
    return out


PACKET_SCHEMA = (
    "experiment_id string, client_id string, packet_index long, timestamp_epoch double, frame_length int, "
    "src_ip string, dst_ip string, src_port int, dst_port int, transport_protocol string, tcp_flags_hex string, "
    "tcp_syn int, tcp_ack int, tcp_fin int, tcp_rst int, retransmission int, tls_record_lengths array<long>, "
    "direction string"
)
