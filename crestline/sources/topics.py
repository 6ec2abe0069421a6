"""Making sure that a topic is there, with the Kafka client that Spark's connector brings along."""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession

log = logging.getLogger("crestline")
PARTITIONS, REPLICATION = 3, 1


def ensure_topic(spark: SparkSession, brokers: list[str], topic: str, partitions: int = PARTITIONS, replication: int = REPLICATION, client=None) -> bool:
    """Create the topic; true if it is new, false if it was there already. Any other refusal is raised.

    client: an admin client; by default one of the JVM's, which needs Spark's Kafka connector on the class path.
    """
    jvm = spark._jvm
    if client is None:
        settings = jvm.java.util.Properties()
        settings.put("bootstrap.servers", ",".join(brokers))
        client = jvm.org.apache.kafka.clients.admin.AdminClient.create(settings)
    wanted = jvm.java.util.ArrayList()
    wanted.add(_new_topic(jvm, topic, partitions, replication))
    try:
        client.createTopics(wanted).all().get()
    except Exception as e:
        if "TopicExistsException" not in str(e):
            raise
        return False
    finally:
        client.close()
    log.info("topic %s made", topic)
    return True


def _new_topic(jvm, topic: str, partitions: int, replication: int):
    return jvm.org.apache.kafka.clients.admin.NewTopic(topic, partitions, jvm.java.lang.Short(str(replication)))
