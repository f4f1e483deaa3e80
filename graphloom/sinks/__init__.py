"""Writers: contract tables, snapshots with manifest and gate, exports."""
