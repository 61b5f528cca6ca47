"""sparkloom: a Spark-native analytics engine."""
