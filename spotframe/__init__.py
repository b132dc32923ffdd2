"""spotframe: a PySpark-native analytics engine for hierarchical spatial measurements."""
