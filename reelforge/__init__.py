"""reelforge: a PySpark-native engine for media-library and viewing-activity data."""
