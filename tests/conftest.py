import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from incidentflow.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=8)
    yield s
    s.stop()


def incident_rows(spark, rows):
    """Incident DataFrame from (id, cause, priority, closure, corridor, station, junction, lat, lng,
    start, closed) tuples; start/closed are ISO text."""
    from pyspark.sql import functions as F
    from incidentflow.schema import INCIDENT_SCHEMA
    full = [(r[0], "unplanned") + tuple(r[1:]) for r in rows]
    df = spark.createDataFrame(full, "incident_id long, event_type string, event_cause string, priority string, "
                                     "requires_road_closure boolean, corridor string, police_station string, "
                                     "junction string, latitude double, longitude double, start_datetime string, "
                                     "closed_datetime string")
    return df.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name)
                       for f in INCIDENT_SCHEMA.fields])
