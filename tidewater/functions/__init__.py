"""Part of the network-flow analytics engine."""
