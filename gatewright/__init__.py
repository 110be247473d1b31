"""gatewright: a PySpark-native text firewall and corpus analytics engine."""
