import gc
import time

import corpus_pipeline
from tracelake.llm import near_copies
from tracelake.llm.common import collect_garbage, stored


def full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if not any(x in b.getName() for x in ("Young", "Concurrent", "Copy", "Scavenge")))


def test_heap_that_a_stage_left_behind_goes_back(spark):
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    collect_garbage(spark)
    least = heap.totalMemory()
    held = []
    while heap.totalMemory() < least + (1 << 30):
        held.append(spark._jvm.java.nio.ByteBuffer.allocate(64 << 20))
    del held
    gc.collect()
    time.sleep(2)  # the JVM hears a little later that they are no longer held
    collect_garbage(spark)
    assert heap.totalMemory() < least + (1 << 29)


def test_every_stage_begins_by_giving_heap_back(spark, docs):
    now = docs([(k, f"one two three four five six seven eight nine ten eleven text{k}", "en" if k % 2 else "fr") for k in range(12)])
    for name, stage in corpus_pipeline.STAGES:
        before = full_collections(spark)
        now = stored(stage(spark, now, "/root/testdata/sf0.001"), name)
        assert full_collections(spark) > before, name


def test_steps_between_near_copies_give_heap_back(spark, docs):
    rows = docs([(k, f"zero one two three four five six seven eight nine ten eleven text{k}") for k in range(12)]).selectExpr("doc_id row", "text")
    before = full_collections(spark)
    assert near_copies.near_copies(rows).select("group").distinct().count() == 1
    assert full_collections(spark) >= before + 3
