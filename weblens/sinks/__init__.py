"""Writers: result logs, exports, store tables."""
