"""Inputs and outputs: manifests (inventory tables), snapshots, operation logs."""
