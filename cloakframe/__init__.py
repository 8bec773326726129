"""cloakframe: a PySpark-native engine for finding and redacting personal data."""
