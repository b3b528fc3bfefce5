"""tabsieve: profiling, mapping, checked extraction and exact export of tables on Spark."""
