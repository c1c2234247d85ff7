from patronlens.session import TARGET_PARTITION_BYTES, cluster_settings


def test_settings_grow_with_the_input():
    small, large = cluster_settings(0, 100), cluster_settings(100 * 2**40, 4000)
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert int(small[key]) == 200
    assert int(large[key]) == 100 * 2**40 // TARGET_PARTITION_BYTES
    assert large["spark.sql.adaptive.skewJoin.enabled"] == "true"
