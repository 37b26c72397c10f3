from corpusloom.llm.store import Scratch


def test_every_few_written_tables_the_driver_collects_its_garbage(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    scratch, before = Scratch(spark, "test-store"), full()
    for i in range(8):
        assert scratch.save(spark.range(3), f"t{i}").count() == 3
    assert full() >= before + 2
