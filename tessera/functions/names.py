"""Names that belong to a language or its runtime rather than to a project."""

# Free-standing names. A call of one is external even if the project has one symbol of that name.
GLOBALS = """
console Math Object Array String Number Boolean Symbol Map Set WeakMap WeakSet Promise Date Error TypeError RangeError SyntaxError ReferenceError JSON RegExp Proxy Reflect Intl Atomics SharedArrayBuffer
ArrayBuffer DataView Float32Array Float64Array Int8Array Int16Array Int32Array Uint8Array Uint16Array Uint32Array parseInt parseFloat isNaN isFinite encodeURIComponent decodeURIComponent
setTimeout setInterval clearTimeout clearInterval setImmediate clearImmediate queueMicrotask structuredClone atob btoa fetch Buffer process global globalThis require __dirname __filename
ref reactive computed watch watchEffect onMounted onUnmounted onBeforeMount onBeforeUnmount onUpdated onBeforeUpdate defineProps defineEmits defineExpose defineComponent defineSlots toRef toRefs unref shallowRef triggerRef
provide inject nextTick h createApp useState useEffect useContext useRef useMemo useCallback useReducer
print len range str int float list dict tuple set type isinstance issubclass hasattr getattr setattr delattr enumerate zip map filter sorted reversed min max sum abs open input super property staticmethod classmethod
fmt log panic make append cap new delete close copy recover complex real imag println eprintln vec format todo unimplemented assert assert_eq assert_ne dbg cfg
System Arrays Collections var_dump echo isset unset empty die exit array_map array_filter array_merge array_keys array_values count strlen substr explode implode trim
""".split()  # fmt: skip

# Methods of built-in types. A call of one with a receiver is not linked by its name alone.
METHODS = """
exec test add delete has get set clear push pop shift unshift slice splice concat join reverse sort map filter reduce reduceRight forEach find findIndex includes indexOf lastIndexOf some every flat flatMap fill keys values entries
then catch finally toString valueOf hasOwnProperty match matchAll replace replaceAll split trim toLowerCase toUpperCase startsWith endsWith padStart padEnd
""".split()  # fmt: skip

# Names that test frameworks and browsers bring along; they count only where the project has no symbol of that name.
AMBIENT = """
describe it test expect beforeEach afterEach beforeAll afterAll suite bench vi jest
URL URLSearchParams FormData Headers Request Response requestAnimationFrame cancelAnimationFrame requestIdleCallback cancelIdleCallback IntersectionObserver ResizeObserver MutationObserver PerformanceObserver
AbortController AbortSignal WebSocket Notification Blob File FileReader CustomEvent Event EventTarget Worker SharedWorker MessageChannel MessagePort
localStorage sessionStorage indexedDB navigator window document location history performance crypto TextEncoder TextDecoder CSS Image Audio Option
""".split()  # fmt: skip
